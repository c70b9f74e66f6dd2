"""What worker processes hold while they code texts, and between tasks."""

import re
import sys

import numpy as np
import pyarrow as pa
import pytest

from trellis.llm import packing, rows

pytestmark = pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory is read from /proc")


def _mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


def test_free_memory_goes_back_after_a_task():
    def run(batches):
        for n in batches:
            # Small pieces, freed but for the last, which keeps the heap from shrinking by itself.
            parts = [np.zeros(2000) for _ in range(n)]
            yield parts[-1]

    before = _mb()
    kept = list(rows.trimmed(run)(iter([8000])))
    assert len(kept) == 1 and _mb() - before < 40


def test_slices_are_small():
    texts = pa.array(["x" * 1000] * 9000)
    found = list(packing._slices(texts))
    assert found[0][0] == 0 and found[-1][1] == 9000 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert max(b - a for a, b in found) * 1000 <= 1 << 21
