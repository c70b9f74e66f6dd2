"""License detection by ordered signature rules, built-in functions only.

A rule is a regular expression over a text's words, a label, a priority and the keywords that a
text must contain before the expression is tried.  Detections are intervals of words; one that
lies inside another of higher priority, or inside a longer one of equal priority, is dropped, and
of rules that find the same interval at the same priority the first one stands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.signatures import TEXTS
from trellis.llm.text import ascii_lower, free_name, held, whole, words


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a regular expression over lower-case words with one space between them; it
    begins and ends at words.  It needs no look-around, and may use groups and choices.  The rule is tried
    on texts that hold a word of each of ``keywords``, alternatives of which are parted by ``|``."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    base: bool = False

    @property
    def regex(self) -> str:
        """For texts in which every word has a space of its own on both sides."""
        return " " + "(?: )?".join(self.pattern.split(" ?")).replace(" ", "  ") + " "


#: The phrases whose places are always reported, with their labels (fixed values).
BASE = [
    Rule("mit", "under the mit license", ("mit", "license"), 1000, 1.0, True),
    Rule("apache-2", "apache license version 2", ("apache", "license"), 1000, 1.0, True),
    Rule("cc-by-nc", "cc by nc", ("cc", "by", "nc"), 1000, 1.0, True),
]

#: Licenses: label, how its name is written, a word that every such name holds, and its identifier.
FAMILIES = [
    ("mit", "(?:mit|expat|x11)", "", "mit"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version)? ?v?1 1", "apache", "apache 1 1"),
    ("apache-2", "apache(?: software)?(?: license)?(?: version)? ?v?2(?: 0)?", "apache", "apache 2 0"),
    ("gpl-2", "(?:gnu )?(?:general public license|gpl)(?: version)? ?v?2(?: 0)?", "", "gpl 2 0"),
    ("gpl-3", "(?:gnu )?(?:general public license|gpl)(?: version)? ?v?3(?: 0)?", "", "gpl 3 0"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public license|lgpl)(?: version)? ?v?2 1", "", "lgpl 2 1"),
    ("lgpl-3", "(?:gnu )?(?:lesser general public license|lgpl)(?: version)? ?v?3(?: 0)?", "", "lgpl 3 0"),
    ("agpl-3", "(?:gnu )?(?:affero general public license|agpl)(?: version)? ?v?3(?: 0)?", "", "agpl 3 0"),
    ("bsd-2", "(?:(?:simplified|freebsd) bsd|(?:bsd )?2 clause(?: bsd)?)", "bsd", "bsd 2 clause"),
    ("bsd-3", "(?:(?:new|modified|revised) bsd|(?:bsd )?3 clause(?: bsd)?)", "bsd", "bsd 3 clause"),
    ("bsd-4", "(?:original bsd|(?:bsd )?4 clause(?: bsd)?)", "bsd", "bsd 4 clause"),
    ("mpl-1.1", "(?:mozilla public license|mpl)(?: version)? ?v?1 1", "", "mpl 1 1"),
    ("mpl-2", "(?:mozilla public license|mpl)(?: version)? ?v?2(?: 0)?", "", "mpl 2 0"),
    ("epl-1", "(?:eclipse public license|epl)(?: version)? ?v?1(?: 0)?", "", "epl 1 0"),
    ("epl-2", "(?:eclipse public license|epl)(?: version)? ?v?2(?: 0)?", "", "epl 2 0"),
    ("cddl-1", "(?:common development and distribution license|cddl)(?: version)? ?v?1(?: 0)?", "", "cddl 1 0"),
    ("eupl-1.2", "(?:european union public licen[cs]e|eupl)(?: version)? ?v?1 2", "", "eupl 1 2"),
    ("artistic-2", "artistic(?: license)?(?: version)? ?v?2(?: 0)?", "artistic", "artistic 2 0"),
    ("bsl-1", "boost software(?: license)?(?: version)?(?: 1(?: 0)?)?", "boost", "bsl 1 0"),
    ("isc", "(?:isc|internet (?:systems|software) consortium)", "", "isc"),
    ("zlib", "(?:zlib(?: libpng)?)", "zlib", "zlib"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)", "", "wtfpl"),
    ("ofl-1.1", "(?:sil )?(?:open font license|ofl)(?: version)?(?: 1 1)?", "", "ofl 1 1"),
    ("python-2", "(?:python software foundation|psf)(?: license)?(?: version)?(?: 2)?", "", "psf 2 0"),
    ("cc0", "(?:creative commons zero|cc0)(?: 1 0)?(?: universal)?", "", "cc0 1 0"),
    ("cc-by", "(?:creative commons attribution|cc by)(?: \\d \\d)?", "", "cc by 4 0"),
    ("cc-by-sa", "(?:creative commons attribution share ?alike|cc by sa)(?: \\d \\d)?", "", "cc by sa 4 0"),
    ("cc-by-nd", "(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: \\d \\d)?", "", "cc by nd 4 0"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)(?: \\d \\d)?", "", "cc by nc 4 0"),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: \\d \\d)?", "", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: \\d \\d)?", "", "cc by nc nd 4 0"),
]

#: The forms of the word (fixed values).
_LICENSE = "license|licence|licensed|licenced|licenses|licences|licensing"

#: How a license is stated: expression, keyword, priority, confidence.  {n} is the name, {i} the identifier.
STATEMENTS = [
    ("spdx licen[cs]e identifier {i}(?: only| or later)?", "spdx", 90, 0.99),
    ("(?:is |are )?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{n}(?: licen[cs]e)?", _LICENSE, 80, 0.95),
    ("(?:released|distributed|published|provided|available) under (?:the )?(?:terms of (?:the )?)?{n}(?: licen[cs]e)?", "under", 80, 0.9),
    ("subject to the (?:terms of the )?{n}(?: licen[cs]e)?", "subject", 75, 0.85),
    ("governed by the (?:terms of the )?{n}(?: licen[cs]e)?", "governed", 75, 0.85),
    ("you may obtain a copy of (?:the )?{n}(?: licen[cs]e)?", "obtain", 70, 0.85),
    ("(?:dual|multi) licen[cs]ed under (?:the )?{n}(?: licen[cs]e)?", _LICENSE, 85, 0.9),
    ("(?:see|read|per) the {n} licen[cs]e", _LICENSE, 50, 0.6),
]

_PUBLISHED = "general public licen[cs]e as published by the free software foundation (?:either )?version "

#: Standard notices, which name no license in one of the statements: label, expression, keywords.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("obtaining", "granted")),
    *((label, f"gnu {kind}{_PUBLISHED}{version}(?: of the licen[cs]e)?", (_LICENSE, "published")) for label, kind, version in [
        ("gpl-2", "", "2(?: 0)?"), ("gpl-3", "", "3(?: 0)?"), ("lgpl-2.1", "lesser ", "2 1"), ("lgpl-3", "lesser ", "3(?: 0)?"), ("agpl-3", "affero ", "3(?: 0)?")]),
]

def default_rules() -> list[Rule]:
    """The base phrases, every statement about every license, the standard notices and the signatures, in order."""
    made = [
        Rule(label, words.format(n=name, i=identifier), tuple(k for k in (keyword, must if "{n}" in words else identifier.split()[0]) if k), priority, confidence)
        for words, keyword, priority, confidence in STATEMENTS
        for label, name, must, identifier in FAMILIES
    ]
    return BASE + made + [Rule(label, pattern, keywords, 85, 0.95) for label, pattern, keywords in [*NOTICES, *TEXTS]]


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tried(rule: Rule, nth: int, line: str, met: str) -> str:
    """SQL for the texts around and in the matches of one rule in ``line``; null unless all keywords are in ``met``."""
    held_ = " and ".join("(" + " or ".join(f"array_contains({met}, {_quoted(w)})" for w in k.split("|")) + ")" for k in rule.keywords) or "true"
    re = _quoted(rule.regex)
    return (f"case when {held_} and {line} rlike {re} then named_struct('nth', {nth}, 's', split({line}, {re}, -1), "
            f"'m', regexp_extract_all({line}, {re}, 0)) end")


#: Words in a piece of the line, which has two spaces between words.
_COUNT = "transform({}, x -> length(regexp_replace(x, '[^ ]', '')) div 2)"
_PLACE = "struct<start:int,stop:int>"
#: The matches of the struct r as an array of (start, stop) in words, from 0; added up in blocks of about the square root of their number,
#: as an array that grows by one is copied each time.
_PLACES = f"""transform(array(named_struct('s', {_COUNT.format('r.s')}, 'm', {_COUNT.format('r.m')})), q -> flatten(
    aggregate(sequence(0, cast(sqrt(size(q.m) - 1) as int)), named_struct('upto', 0L, 'out', cast(array() as array<array<{_PLACE}>>)),
      (a, b) -> aggregate(filter(sequence(b * cast(ceil(sqrt(size(q.m))) as int), (b + 1) * cast(ceil(sqrt(size(q.m))) as int) - 1), i -> i < size(q.m)),
        named_struct('upto', a.upto, 'out', cast(array() as array<{_PLACE}>)),
        (c, i) -> named_struct('upto', c.upto + q.s[i] + q.m[i],
          'out', concat(c.out, array(named_struct('start', cast(c.upto + q.s[i] as int), 'stop', cast(c.upto + q.s[i] + q.m[i] as int))))),
        c -> named_struct('upto', c.upto, 'out', concat(a.out, array(c.out)))),
      a -> a.out)))[0]"""


def _not_contained(every: str) -> str:
    """SQL for the detections of ``every``, sorted by start, that none of higher rank contains.

    They are taken in blocks of about the square root of their number; what may contain one of a block begins at most the longest detection before it.
    """
    block = f"cast(ceil(sqrt(size({every}))) as int)"
    return f"""case when size({every}) = 0 then {every} else flatten(transform(sequence(0, cast(sqrt(size({every}) - 1) as int)), k ->
      transform(array(named_struct('own', slice({every}, k * {block} + 1, {block}), 'longest', array_max(transform({every}, e -> e.stop - e.start)))), z ->
        transform(array(filter({every}, e -> e.start > get(z.own, 0).start - z.longest and e.start <= get(z.own, size(z.own) - 1).start)), near ->
          filter(z.own, d -> d.base or not exists(near, e -> e.start <= d.start and e.stop >= d.stop and
            (e.priority > d.priority or e.priority = d.priority and (e.stop - e.start > d.stop - d.start or e.stop - e.start = d.stop - d.start and e.nth < d.nth)))))[0])[0])) end"""


def detect(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``detections``.

    A detection is (start, stop, nth, label, priority, conf, base), words from 0, stop exclusive, ``nth`` the
    rule's place, in order of start.  Base rules' detections always stay.  Case is folded for A-Z only.  A null or
    empty text has no words; null ids and repeated rows keep their rows, each with its own result.  Columns of the added
    names are replaced, all others stay whatever their names.  One projection of the scan: nothing is shuffled or collected.
    """
    rules = default_rules() if rules is None else rules
    taken = [*docs.columns]
    own, line, met, every = (taken.append(free_name(n, taken)) or taken[-1] for n in ("low_words", "word_line", "keywords_met", "all_found"))
    keys = sorted({w for r in rules for k in r.keywords for w in k.split("|")})
    listed = f"cast(array({', '.join(map(_quoted, keys))}) as array<string>)"
    rows = held(docs, own, words(ascii_lower(whole(text))))
    rows = held(rows, met, F.expr(f"array_intersect({own}, {listed})"))
    always = any(not r.keywords for r in rules)
    near = F.lit(always) | (F.size(met) > 0)
    # Every word between two spaces of its own.
    rows = held(rows, line, F.when(near & (F.size(own) > 0), F.concat(F.lit(" "), F.array_join(own, "  "), F.lit(" "))))
    tried = "filter(array(" + ", ".join(_tried(r, i, line, met) for i, r in enumerate(rules)) + "), r -> r is not null)"
    known = "array(" + ", ".join(f"named_struct('label', {_quoted(r.label)}, 'priority', {r.priority}, 'conf', {r.confidence}D, 'base', {str(r.base).lower()})" for r in rules) + ")"
    found = f"""flatten(transform({tried}, r -> transform({_PLACES}, p -> named_struct('start', p.start, 'stop', p.stop, 'nth', r.nth,
        'label', {known}[r.nth].label, 'priority', {known}[r.nth].priority, 'conf', {known}[r.nth].conf, 'base', {known}[r.nth].base))))"""
    rows = held(rows, every, F.expr(f"case when {line} is not null then array_sort({found}) end"))
    kept = _not_contained(every)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "detections")), F.size(own).cast("long").alias("n_words"),
                       F.expr(f"coalesce({kept}, filter({every}, d -> false))").alias("detections"))


def summary(found: DataFrame) -> DataFrame:
    """A row per document of ``detect``: counts and places of base phrases, labels and a score.

    ``score`` is the largest confidence among the detections, 0 without any.
    """
    joined = "array_join(array_sort(array_distinct(transform({}, d -> d.label))), ',')"
    base = "filter(detections, d -> d.base)"
    return found.select(
        "doc_id", "n_words", F.expr(f"coalesce(size({base}), 0)").cast("long").alias("n_base"),
        F.expr(f"array_min(transform({base}, d -> d.start))").cast("long").alias("first_word"),
        F.expr(f"array_max(transform({base}, d -> d.start))").cast("long").alias("last_word"),
        F.expr(f"coalesce({joined.format(base)}, '')").alias("base_labels"),
        F.expr(f"coalesce({joined.format('detections')}, '')").alias("labels"),
        F.expr("coalesce(array_max(transform(detections, d -> d.conf)), 0D)").alias("score"))
