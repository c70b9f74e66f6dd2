"""The sectioned mesh format 2.x as data sources of Spark: files and folders read by byte ranges.

``mesh_marks`` gives the places of section lines, found by one pass over all ranges; ``mesh_section``
reads the lines of one kind of section, whose places it is told.  A range takes the lines that begin
in it, so no line is copied, shuffled or read by two tasks.  Paths are those that Arrow's file systems open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE = 32 << 20
#: Section lines in all files at most, as they pass through the driver: a file has about ten.
MAX_MARKS = 1_000_000
#: Kinds of sections, the lines that open them, and their columns (fixed values).
SECTIONS = {
    "nodes": ("$Nodes", "file string, block long, id long, x double, y double, z double"),
    "elements": ("$Elements", "file string, block long, id long, kind int, tag int, entity int, nodes array<long>"),
    "names": ("$PhysicalNames", "file string, block long, dim int, tag int, name string"),
}
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}


@dataclass
class Range(InputPartition):
    """Bytes ``lo`` to ``hi`` of the file at ``path``, in section number ``block`` of the mesh ``file``."""

    path: str
    lo: int
    hi: int
    file: str = ""
    block: int = 0


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Files at a path, or in a folder but for hidden ones, in order of name, with their sizes."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and not f.base_name.startswith((".", "_"))]
    scheme = "" if path.startswith("file:") or "://" not in path else path.split("://")[0] + "://"
    return sorted((scheme + f.path, f.size) for f in found)


def lines_of(part: Range, most: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """Offset and text of the lines that begin in a range, read about ``most`` bytes at a time."""
    system, inner = _opened(part.path)
    with system.open_input_file(inner) as source:
        start = max(0, part.lo - 1)
        source.seek(start)
        at, rest, skip = start, b"", part.lo > 0  # what ends at or before lo is another range's
        while at < part.hi:
            more = source.read(most)
            whole, ends = rest + more, not more
            *done, rest = whole.split(b"\n")
            if ends and rest:
                done, rest = [*done, rest], b""
            for line in done:
                if not skip and at < part.hi:
                    yield at, line.decode("utf-8", "replace").strip()
                at, skip = at + len(line) + 1, False
            if ends:
                return


class _Reader(DataSourceReader):
    def __init__(self, ranges: list[Range], take):
        self.ranges, self.take = ranges, take

    def partitions(self) -> list[Range]:
        return self.ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.take(partition) if partition.path else iter(())


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _cut(path: str, lo: int, hi: int, size: int, file: str = "", block: int = 0) -> list[Range]:
    return [Range(path, a, min(a + size, hi), file, block) for a in range(lo, hi, size)]


class MeshMarks(DataSource):
    """``file, at, after, mark``: lines that open or close a section, where they begin and where the next line does."""

    @classmethod
    def name(cls) -> str:
        return "mesh_marks"

    def schema(self) -> str:
        return "file string, at long, after long, mark string"

    def reader(self, schema) -> DataSourceReader:
        size = int(self.options.get("range_bytes", RANGE))
        ranges = [r for f, n in files(self.options["path"]) for r in _cut(f, 0, n, size)]

        def take(part: Range) -> Iterator[pa.RecordBatch]:
            opened, rows = None, []
            for at, line in lines_of(part):
                if opened is not None:
                    rows.append((*opened[:2], at, opened[2]))
                    opened = None
                if line.startswith("$"):
                    opened = (part.path, at, line)
            if opened is not None:  # the next line is in another range
                rows.append((*opened[:2], None, opened[2]))
            return _batches(iter(rows), ["file", "at", "after", "mark"], [pa.string(), pa.int64(), pa.int64(), pa.string()])

        return _Reader(ranges, take)


def _parsed(kind: str, part: Range, words: list[str]) -> tuple | None:
    """A section's line as a row; none where it is not one of the kind (as the line of its count)."""
    try:
        if kind == "nodes":
            return (part.file, part.block, int(words[0]), *(float(w) for w in words[1:4])) if len(words) >= 4 else None
        if kind == "elements":
            if len(words) < 3:
                return None
            tags = [int(w) for w in words[3 : 3 + int(words[2])]]
            return (part.file, part.block, int(words[0]), int(words[1]), *(tags + [None, None])[:2], [int(w) for w in words[3 + len(tags) :]])
        return (part.file, part.block, int(words[0]), int(words[1]), " ".join(words[2:]).strip('"')) if len(words) >= 3 else None
    except ValueError:
        return None


class MeshSection(DataSource):
    """The rows of all sections of one kind (option ``kind``), at the places of option ``sections``."""

    @classmethod
    def name(cls) -> str:
        return "mesh_section"

    def schema(self) -> str:
        return SECTIONS[self.options["kind"]][1]

    def reader(self, schema) -> DataSourceReader:
        kind, size = self.options["kind"], int(self.options.get("range_bytes", RANGE))
        ranges = [r for path, lo, hi, file, block in json.loads(self.options["sections"]) for r in _cut(path, lo, hi, size, file, block)]
        columns = [c.split(" ") for c in SECTIONS[kind][1].split(", ")]

        def take(part: Range) -> Iterator[pa.RecordBatch]:
            rows = (_parsed(kind, part, line.split()) for _, line in lines_of(part))
            return _batches((r for r in rows if r is not None), [c[0] for c in columns], [_TYPES[c[1]] for c in columns])

        return _Reader(ranges, take)


def _sections(marks: list, sizes: dict[str, int], whole: str | None) -> dict[str, list[tuple]]:
    """The places of each kind's sections: path, first byte and end of bytes, mesh and number of section."""
    places: dict[str, list[tuple]] = {kind: [] for kind in SECTIONS}
    kinds = {mark.lower(): kind for kind, (mark, _) in SECTIONS.items()}
    order, opened, count = sorted(sizes), None, 0
    for row in sorted(marks, key=lambda r: (r.file, r.at)):
        if opened is None:
            opened = row
            continue
        if row.mark.lower() != opened.mark.lower().replace("$", "$end") or (whole is None and row.file != opened.file):
            break
        lo = opened.after if opened.after is not None else opened.at + len(opened.mark) + 1
        if opened.mark.lower() in kinds:
            for path in order[order.index(opened.file) : order.index(row.file) + 1]:
                first, end = lo if path == opened.file else 0, row.at if path == row.file else sizes[path]
                places[kinds[opened.mark.lower()]].append((path, first, end, whole or path, count))
        opened, count = None, count + 1
    if opened is not None:
        raise ValueError(f"section {opened.mark} of {opened.file} is not closed")
    return places


def read_sections(spark: SparkSession, path: str, one: bool = False, range_bytes: int = RANGE) -> dict[str, DataFrame]:
    """``nodes``, ``elements`` and ``names`` of a file, or of all files of a folder, which are meshes or (``one``) parts of one in order of name.

    Rows carry their ``file`` and ``block``, the number of their section, as ids hold within a file
    alone; elements have both tags (``tag``, the group, and ``entity``; null where there are fewer).  Several sections of a kind in a file are
    several blocks.  A section without its closing line is an error; lines that are no rows of their section are left out; an empty file has no rows.
    """
    spark.dataSource.register(MeshMarks)
    spark.dataSource.register(MeshSection)
    found = spark.read.format("mesh_marks").option("range_bytes", range_bytes).load(path).limit(MAX_MARKS + 1).collect()
    if len(found) > MAX_MARKS:
        raise ValueError(f"more than {MAX_MARKS} section lines")
    places = _sections(found, dict(files(path)), path if one else None)
    return {kind: spark.read.format("mesh_section").option("kind", kind).option("range_bytes", range_bytes).option("sections", json.dumps(places[kind])).load() for kind in SECTIONS}
