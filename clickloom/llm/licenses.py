"""Licence notices: exact phrases of words, and fuzzy search for short notices.

The fuzzy search cuts each notice of allowed edits e into e + 1 pieces. A text within e edits of the
notice holds one piece unchanged (pigeonhole), so one exact search for all pieces (an automaton) locates candidates; the
`regex` library then matches the whole notice with at most e errors around each candidate, and the match
gives the edits and the span.

Texts are normalised first: A-Z lower-cased, words are runs of 0-9, a-z and characters beyond ASCII,
joined by one space. Spans are reported as code point offsets of the source text.

Defined cases: null is the empty text (no words, no labels, score 0). Repeated rows each keep a row. Ties between
overlapping matches of one label: fewest edits, then the first. The words that tell one licence from another
take fewer edits than would make them another word. Very long texts are scanned whole, one at a time. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import filled, ship, text_steps, tidied

#: Exact phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices: text, label, and the words that tell the licence (as alternatives) with the edits each takes. They are found within
#: one edit for each full seven characters, three at most.
NOTICES = (
    ("under the mit license", "mit", {"mit": 0}),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", {}),
    ("licensed under the apache license version 2", "apache-2", {"apache": 1, "2|two|ii": 0}),
    ("apache license version 2", "apache-2", {"apache": 1, "2|two|ii": 0}),
    ("apache software license", "apache", {"apache": 1}),
    ("apache license 2 0", "apache-2", {"apache": 1, "2|two|ii": 0}),
    ("spdx license identifier mit", "mit", {"spdx": 1, "mit": 0}),
    ("spdx license identifier apache 2 0", "apache-2", {"spdx": 1, "apache": 1, "2": 0}),
    ("spdx license identifier bsd", "bsd", {"spdx": 1, "bsd": 0}),
    ("spdx license identifier isc", "isc", {"spdx": 1, "isc": 0}),
    ("spdx license identifier gpl", "gpl", {"spdx": 1, "gpl": 0}),
    ("spdx license identifier lgpl", "lgpl", {"spdx": 1, "lgpl": 0}),
    ("spdx license identifier agpl", "agpl", {"spdx": 1, "agpl": 0}),
    ("spdx license identifier mpl", "mpl", {"spdx": 1, "mpl": 0}),
    ("spdx license identifier cc0", "cc0", {"spdx": 1, "cc0": 0}),
    ("gnu gpl v3", "gpl", {"gnu": 0, "gpl": 0}),
    ("gnu gpl v2", "gpl", {"gnu": 0, "gpl": 0}),
    ("gnu lgpl", "lgpl", {"gnu": 0, "lgpl": 0}),
    ("gnu agpl", "agpl", {"gnu": 0, "agpl": 0}),
    ("creative commons attribution 4 0", "cc-by", {"attribution": 2, "4|3|2": 0}),
    ("creative commons attribution noncommercial", "cc-by-nc", {"noncommercial": 2}),
    ("creative commons attribution sharealike", "cc-by-sa", {"sharealike": 2}),
    ("creative commons attribution noderivatives", "cc-by-nd", {"noderivatives": 2}),
    ("creative commons attribution license", "cc-by", {"attribution": 2, "license": 2}),
    ("creative commons zero", "cc0", {"zero": 0}),
    ("cc0 1 0 universal", "cc0", {"cc0": 0}),
    ("gnu general public license", "gpl", {"gnu": 1}),
    ("gnu lesser general public license", "lgpl", {"lesser": 2}),
    ("gnu library general public license", "lgpl", {"library": 2}),
    ("gnu affero general public license", "agpl", {"affero": 2}),
    ("gnu free documentation license", "gfdl", {"documentation": 3}),
    ("mozilla public license", "mpl", {"mozilla": 2}),
    ("eclipse public license", "epl", {"eclipse": 2}),
    ("eclipse distribution license", "edl", {"eclipse": 2, "distribution": 3}),
    ("european union public licence", "eupl", {"european": 2, "union": 1}),
    ("common development and distribution license", "cddl", {"development": 2}),
    ("common public license", "cpl", {"common": 1}),
    ("microsoft public license", "ms-pl", {"microsoft": 2}),
    ("microsoft reciprocal license", "ms-rl", {"reciprocal": 2}),
    ("boost software license", "bsl", {"boost": 1}),
    ("academic free license", "afl", {"academic": 2}),
    ("artistic license", "artistic", {"artistic": 1}),
    ("educational community license", "ecl", {"educational": 2}),
    ("open software license", "osl", {"open": 0}),
    ("sil open font license", "ofl", {"font": 0}),
    ("open database license", "odbl", {"database": 2}),
    ("python software foundation license", "psf", {"python": 1}),
    ("server side public license", "sspl", {"server": 1, "side": 0}),
    ("business source license", "busl", {"business": 2}),
    ("universal permissive license", "upl", {"universal": 2}),
    ("zope public license", "zpl", {"zope": 0}),
    ("redistribution and use in source and binary forms", "bsd", {}),
    ("under the bsd license", "bsd", {"bsd": 0}),
    ("bsd 3 clause", "bsd", {"bsd": 0}),
    ("bsd 2 clause", "bsd", {"bsd": 0}),
    ("under the isc license", "isc", {"isc": 0}),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", {}),
    ("under the zlib license", "zlib", {"zlib": 0}),
    ("this software is provided as is without any express or implied warranty", "zlib", {}),
    ("do what the fuck you want to public license", "wtfpl", {}),
    ("this is free and unencumbered software released into the public domain", "unlicense", {}),
)
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:int,end:int,edits:int>>"
)
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    edits: int
    pattern: regex.Pattern
    telling: tuple[regex.Pattern, ...]  # each has to be in a match


def allowed(notice: str) -> int:
    return max(1, min(3, len(notice) // 7))


@lru_cache(None)
def compiled() -> tuple[tuple[Notice, ...], ahocorasick.Automaton]:
    """The notices, and an automaton of their pieces: (number of the notice, offset in it, length)."""
    made, seeds = [], {}
    for i, (text, label, words) in enumerate(NOTICES):
        raw, edits = text.encode(), allowed(text)
        cuts = [round(j * len(raw) / (edits + 1)) for j in range(edits + 2)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            seeds.setdefault(text[a:b], []).append((i, a, b - a))
        pattern = regex.compile(rb"(?b)(?<= )(?=[^ ])(?:" + regex.escape(raw) + rb"){e<=%d}(?<=[^ ])(?= )" % edits)
        made.append(Notice(raw, label, edits, pattern, tuple(telling(text.split(), word, e) for word, e in words.items())))
    automaton = ahocorasick.Automaton()
    for seed, places in seeds.items():
        automaton.add_word(seed, places)
    automaton.make_automaton()
    return tuple(made), automaton


def telling(notice: list[str], word: str, edits: int) -> regex.Pattern:
    """A telling word on its own, or run together with an unchanged neighbour."""
    i = notice.index(word.split("|")[0])
    before = "".join(rf"|(?<=(?<![^ ]){w})" for w in notice[max(0, i - 1) : i])
    after = "".join(rf"|(?={w}(?![^ ]))" for w in notice[i + 1 : i + 2])
    fuzzy = f"{{e<={edits}}}" if edits else ""
    return regex.compile(rf"(?:(?<![^ ]){before})(?:{word}){fuzzy}(?:(?![^ ]){after})".encode())


def places(words: bytes, phrase: bytes) -> list[int]:
    """Byte places (in b' w1 w2 ') where the phrase's words stand consecutively, overlapping ones too."""
    sought, found, at = b" " + phrase + b" ", [], words.find(b" " + phrase + b" ")
    while at >= 0:
        found.append(at)
        at = words.find(sought, at + 1)
    return found


def fuzzy(words: bytes) -> list[tuple[str, int, int, int]]:
    """(label, first byte, end byte, edits) of the notices within their edits, in place order."""
    notices, automaton = compiled()
    windows_of: dict[int, list[tuple[int, int]]] = {}
    for last, hits in automaton.iter(words.decode("latin-1")):  # a character for each byte
        for i, offset, length in hits:
            start, notice = last + 1 - length - offset, notices[i]
            windows_of.setdefault(i, []).append((max(0, start - notice.edits - 1), min(len(words), start + len(notice.text) + notice.edits + 1)))
    found = {}
    for i, windows in windows_of.items():
        notice = notices[i]
        size, e = len(notice.text), notice.edits
        windows.sort()
        reach = 0
        for a, b in windows:
            a = max(a, reach)  # what lies before has been searched already
            while b - a >= size - e:
                match = notice.pattern.search(words, a, b)
                if not match:
                    break
                if not all(t.search(words, match.start(), match.end()) for t in notice.telling):
                    a = match.start() + 1
                    continue
                edits = sum(match.fuzzy_counts)
                key = (notice.label, match.start())
                if key not in found or found[key][1] > edits:
                    found[key] = (match.end(), edits)
                a = reach = match.end()
    # of overlapping matches of one label the one with the fewest edits stays
    kept, taken = [], {}  # of each label: starts and ends in order, that do not overlap
    for (label, start), (end, edits) in sorted(found.items(), key=lambda x: (x[1][1], x[0][1], x[0][0])):
        starts, ends = taken.setdefault(label, ([], []))
        i = bisect_right(starts, start)
        if (i == 0 or ends[i - 1] <= start) and (i == len(starts) or end <= starts[i]):
            starts.insert(i, start)
            ends.insert(i, end)
            kept.append((label, start, end, edits))
    return sorted(kept, key=lambda k: (k[1], k[0]))


def scan(text: str) -> tuple:
    """The output columns after doc_id for one text."""
    words = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()) + b" "
    blanks = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32)
    before = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731  blanks before a place
    n_words = len(blanks) - 1 if len(words) > 2 else 0
    base, labels, spans, score = [], set(), [], 0.0
    for phrase, label in PHRASES.items():
        for at in places(words, phrase.encode()):
            base.append(before(at))
            labels.add(label)
            score = 1.0
    near = fuzzy(words)
    if near:
        spans_of = [m.span() for m in _WORD.finditer(text)]
        for label, start, end, edits in near:
            first, last = before(start) - 1, before(end) - 1
            spans.append({"label": label, "start": spans_of[max(first, 0)][0], "end": spans_of[max(last, 0)][1], "edits": edits})
            score = max(score, 1.0 - edits / max(1, end - start))
    every = labels | {s["label"] for s in spans}
    return n_words, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, spans


def license_scan(docs: DataFrame) -> DataFrame:
    """Scan every whole text: SCHEMA."""
    ship(docs.sparkSession)
    schema = docs.sparkSession.createDataFrame([], SCHEMA).schema
    names = schema.names
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_steps(filled(batch.column(1))):
                rows = list(zip(*map(scan, texts)))
                columns = [pa.array(v, t) for v, t in zip(rows, [*arrow, span])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), schema)
