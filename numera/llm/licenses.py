"""License scans: ordered signature rules over the words of a text.

Each rule is a pattern with a label, a priority, a weight and the keywords of which a text needs one before the pattern
is tried at all. Of the places found, one that lies within another of at least its priority is suppressed, so that
"gnu lesser general public license version 3" is that license alone and not also the families that its words contain.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
BASE_WEIGHT = 0.6


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


#: Families with versions: label, long name, short names, versions (in words, a point is a gap).
VERSIONED = (
    ("gpl", "gnu general public licen[cs]e", ("gpl", "gnu gpl"), ("1", "2", "3")),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", ("lgpl", "gnu lgpl"), ("2", "2 1", "3")),
    ("agpl", "gnu affero general public licen[cs]e", ("agpl", "gnu agpl"), ("1", "3")),
    ("gfdl", "gnu free documentation licen[cs]e", ("gfdl", "fdl"), ("1 1", "1 2", "1 3")),
    ("apache", "apache (?:software )?licen[cs]e", ("apache", "asl"), ("1", "1 1", "2", "2 0")),
    ("mpl", "mozilla public licen[cs]e", ("mpl",), ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public licen[cs]e", ("epl",), ("1 0", "2 0")),
    ("cddl", "common development and distribution licen[cs]e", ("cddl",), ("1 0", "1 1")),
    ("cpl", "common public licen[cs]e", ("cpl",), ("1 0",)),
    ("eupl", "european union public licen[cs]e", ("eupl",), ("1 0", "1 1", "1 2")),
    ("afl", "academic free licen[cs]e", ("afl",), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "open software licen[cs]e", ("osl",), ("1 0", "2 0", "2 1", "3 0")),
    ("artistic", "artistic licen[cs]e", ("artistic",), ("1 0", "2 0")),
    ("lppl", "latex project public licen[cs]e", ("lppl",), ("1 0", "1 2", "1 3")),
    ("ofl", "(?:sil )?open font licen[cs]e", ("ofl",), ("1 0", "1 1")),
    ("odbl", "open database licen[cs]e", ("odbl",), ("1 0",)),
    ("bsl", "boost software licen[cs]e", ("bsl",), ("1 0",)),
    ("busl", "business source licen[cs]e", ("busl",), ("1 1",)),
    ("php", "php licen[cs]e", (), ("3 0", "3 01")),
    ("zpl", "zope public licen[cs]e", ("zpl",), ("1 1", "2 0", "2 1")),
    ("cecill", "cecill (?:free software )?licen[cs]e", ("cecill",), ("1 0", "2 0", "2 1")),
    ("ms-pl", "microsoft public licen[cs]e", ("ms pl",), ()),
    ("ms-rl", "microsoft reciprocal licen[cs]e", ("ms rl",), ()),
    ("upl", "universal permissive licen[cs]e", ("upl",), ("1 0",)),
    ("ecl", "educational community licen[cs]e", ("ecl",), ("1 0", "2 0")),
    ("npl", "netscape public licen[cs]e", ("npl",), ("1 0", "1 1")),
    ("qpl", "q public licen[cs]e", ("qpl",), ("1 0",)),
    ("ipl", "ibm public licen[cs]e", ("ipl",), ("1 0",)),
    ("apsl", "apple public source licen[cs]e", ("apsl",), ("1 0", "1 2", "2 0")),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", ("wtfpl",), ("1", "2")),
)
#: Families without versions: label, patterns.
PLAIN = (
    ("mit", ("mit licen[cs]e", "expat licen[cs]e", "permission is hereby granted free of charge to any person obtaining a copy")),
    ("mit-0", ("mit no attribution", "mit 0")),
    ("x11", ("x11 licen[cs]e",)),
    ("isc", ("isc licen[cs]e", "permission to use copy modify and or distribute this software for any purpose with or without fee")),
    ("bsd", ("bsd licen[cs]e", "bsd style licen[cs]e", "redistribution and use in source and binary forms with or without modification")),
    ("bsd-0", ("bsd zero clause", "0bsd", "bsd 0 clause")),
    ("bsd-2", ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd licen[cs]e")),
    ("bsd-3", ("bsd 3 clause", "3 clause bsd", "new bsd licen[cs]e", "modified bsd licen[cs]e")),
    ("bsd-4", ("bsd 4 clause", "4 clause bsd", "original bsd licen[cs]e")),
    ("zlib", ("zlib licen[cs]e", "zlib libpng licen[cs]e")),
    ("unlicense", ("the unlicense", "free and unencumbered software released into the public domain")),
    ("public-domain", ("public domain", "dedicated to the public domain")),
    ("psf", ("python software foundation licen[cs]e", "psf licen[cs]e")),
    ("postgresql", ("postgresql licen[cs]e",)),
    ("ncsa", ("ncsa open source licen[cs]e", "university of illinois ncsa")),
    ("openssl", ("openssl licen[cs]e",)),
    ("ruby", ("ruby licen[cs]e",)),
    ("vim", ("vim licen[cs]e",)),
    ("w3c", ("w3c software (?:notice and )?licen[cs]e", "w3c licen[cs]e")),
    ("json", ("json licen[cs]e", "the software shall be used for good not evil")),
    ("beerware", ("beerware", "beer ware licen[cs]e")),
    ("sleepycat", ("sleepycat licen[cs]e",)),
    ("all-rights-reserved", ("all rights reserved",)),
    ("proprietary", ("proprietary licen[cs]e", "proprietary and confidential", "end user licen[cs]e agreement")),
    ("cc0", ("cc0", "cc 0", "creative commons zero")),
)
#: Parts of the Creative Commons names: label part, short words, long words.
CREATIVE = (("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by-nc", "by nc", "attribution non ?commercial"),
            ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
IN_FRONT = "(?:spdx licen[cs]e identifier|licen[cs]ed under(?: the terms of)?(?: the)?|released under(?: the)?|distributed under(?: the)?|subject to the terms of the|under the terms of the)"


@functools.lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, the first of them with the highest priority."""
    out = []

    def add(label, pattern, keywords, priority, weight):
        out.append(Rule(label, pattern, tuple(keywords), priority, weight))

    for label, long, short, versions in VERSIONED:
        keys = {"php", "sil"} & {long[:3]} or {w for w in re.findall("[a-z0-9]{3,}", re.sub(r"\(.*?\)|licen\[cs\]e", " ", long)) if w not in ("the", "and", "you", "what", "want", "public", "open", "software", "free", "source", "general", "gnu")}
        if not keys:  # a long name of common words alone: one that it must contain
            must = re.findall("[a-z0-9]+", re.sub(r"\(.*?\)|licen\[cs\]e", " ", long))
            keys = {next((w for w in ("gnu", "software") if w in must), min(must, key=len))}
        keys |= {s.split(" ")[-1] for s in short} | ({"gnu"} if "gnu" in long else set())
        names = "|".join([long, *short])
        # gplv2 is one word; without the v only where no program is called so (apache2)
        glue = ("v", "") if label.endswith("gpl") else ("v",)
        for v in versions:
            tail = v if " " not in v else v + "(?: 0)?"
            stem = f"(?:{names}) (?:version |v ?|ver )?{tail}"
            own = keys | {s.split(" ")[-1] + g + v.split(" ")[0] for s in short for g in glue}
            if short:
                stem = f"(?:{stem}|(?:{'|'.join(short)})(?:{'|'.join(glue)}){tail})"
            add(f"{label}-{v.replace(' ', '.')}", stem, own, 60, 0.9)
            add(f"{label}-{v.replace(' ', '.')}-or-later", f"{stem} or (?:any |at your option any )?later(?: version)?", own, 80, 0.95)
            add(f"{label}-{v.replace(' ', '.')}", f"{IN_FRONT} {stem}", own, 70, 0.95)
        add(label, f"{IN_FRONT} (?:{names})", keys, 50, 0.85)
        add(label, long, keys, 40, 0.7)
        for s in short:
            add(label, f"{s} licen[cs]ed?", {s.split(" ")[-1]}, 35, 0.6)
    for label, patterns in PLAIN:
        for p in patterns:
            keys = [max(re.findall("[a-z0-9]+", re.sub(r"\(.*?\)|licen\[cs\]e", " ", p)) or ["license"], key=len)]
            add(label, f"{IN_FRONT} (?:the )?{p}", keys, 50, 0.9)
            add(label, p, keys, 30, 0.65)
    for part, short, long in CREATIVE:
        for v in CC_VERSIONS:
            for where in ("", " international", " unported"):
                add(f"cc-{part}-{v.replace(' ', '.')}", f"(?:cc {short}|creative commons {long}(?: licen[cs]e)?) {v}{where}", ["cc", "commons"], 60 + bool(where) * 5 + len(part), 0.95)
        add(f"cc-{part}", f"(?:cc {short}|creative commons {long})(?: licen[cs]e)?", ["cc", "commons"], 30 + len(part), 0.75)
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern)))


class Scanner:
    def __init__(self):
        self.rules = [(re.compile(b"(?<![^ ])(?:" + r.pattern.encode() + b")(?![^ ])"), r) for r in rules()]
        self.by_key: dict[bytes, list[int]] = {}
        for k, (_, r) in enumerate(self.rules):
            for w in r.keywords:
                self.by_key.setdefault(w.encode(), []).append(k)
        self.keys = frozenset(self.by_key)
        self.base = [(f"(?= {p} )".encode(), label, p.count(" ") + 1) for p, label in BASE]
        self.base_words = frozenset(p.split(" ")[0].encode() for p, _ in BASE)
        # words are runs of a-z, 0-9 and non-ASCII characters, after lower-casing
        self.plain = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int, int, float]], list[tuple[str, int, int, float]]]:
        """Number of words; base places and the rules' places as (label, first word, past word, weight)."""
        words = text.translate(self.plain).split()
        present = self.keys.intersection(words)
        n, joined = len(words), b""
        base: list[tuple[str, int, int, float]] = []
        if present or self.base_words.intersection(words):
            joined = b" ".join(words)
        if joined:
            padded = b" " + joined + b" "
            for pattern, label, size in self.base:
                at = word = 0
                for m in re.finditer(pattern, padded):
                    word += padded.count(b" ", at, m.start())
                    at = m.start()
                    base.append((label, word, word + size, BASE_WEIGHT))
        found = []
        for k in sorted({k for w in present for k in self.by_key[w]}):
            pattern, r = self.rules[k]
            at = word = 0
            for m in pattern.finditer(joined):
                word += joined.count(b" ", at, m.start())
                at = m.start()
                found.append((r.priority, word, word + m.group().count(b" ") + 1, r.label, r.weight))
        return n, base, self.resolve(found)

    @staticmethod
    def resolve(found):
        """Places that do not lie within another of at least their priority; of equal ones the first label stays."""
        kept: list[tuple[str, int, int, float]] = []
        # an accepted place of higher priority, or of equal priority and greater length, comes before what it contains
        furthest: dict[int, int] = {}
        for priority, start, end, label, weight in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
            if any(furthest.get(s, 0) >= end for s in range(max(0, start - 40), start + 1)):
                continue
            furthest[start] = max(end, furthest.get(start, 0))
            kept.append((label, start, end, weight))
        return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


PLACE = "array<struct<label: string, first: long, past: long, weight: double>>"


def _scan(it):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("past", pa.int64()), ("weight", pa.float64())]))
    scan = scanner().scan
    named = lambda places: [dict(zip(("label", "first", "past", "weight"), p)) for p in places]
    for b in it:
        got = [scan(t) for t in b.column(b.num_columns - 1).to_pylist()]
        made = [pa.array([g[0] for g in got], pa.int64()), pa.array([named(g[1]) for g in got], kind), pa.array([named(g[2]) for g in got], kind)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "n_words", "base", "found"])


def license_scan(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """A struct _doc of the carried columns, n_words long, and the places base and found: arrays of label, first word,
    past word and weight, in the order of the text.

    A null text is an empty one, with no words and no places. Repeated rows stay repeated. An empty table gives an
    empty result.
    """
    rows = docs.select(F.struct(*carry).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    return rows.mapInArrow(_scan, f"_doc {rows.schema['_doc'].dataType.simpleString()}, n_words long, base {PLACE}, found {PLACE}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = license_scan(table(spark, sf_dir, "documents"), ["doc_id"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    missed = F.aggregate(F.transform(F.concat("base", "found"), lambda p: 1 - p["weight"]), F.lit(1.0), lambda a, x: a * x)
    return places.select(
        "_doc.doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", "found.label")).alias("labels"), F.round(1 - missed, 9).alias("score"), "found",
    )


#: The base part in DuckDB, for tests.
BASE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) t(p, label)),
hits AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, label, p, unnest(range(1, len(w) + 1)) AS i FROM w, p) WHERE w[i:i + len(p) - 1] = p)
SELECT doc_id, len(w) AS n_words, count(i) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN hits USING (doc_id) GROUP BY doc_id, len(w)
"""
