"""Personal data: offset-preserving deobfuscation.

Plain patterns find identifiers in the text as it stands. For disguised ones a chain of transducers
rewrites the text piece by piece, and keeps its edits, so that each character of the result leads back to the source
characters that it stands for:

1. homoglyphs and width variants of letters, digits and signs become ASCII;
2. runs of spelled digits ("four one five") become digits;
3. spaced-out letters beside an "@" move together;
4. "at" and "dot" disguises ("name [at] site (dot) org", "name_at_site_dot_org", "name @ site . org", "192[.]168 dot 1 dot 10") become
   "@" and "." where a name, a domain that ends in letters or four numbers stand around them. A bare "at" needs a disguised dot as well.

The same patterns run on the result, and what they find is mapped back to source characters. A found span
is added unless it overlaps a plain one of its kind, so plain spans always stay. Blanks, names and domains may be of any length. All steps
are linear in the length of the text. Credentials (`secrets`) are found by patterns of their own; they are no spans.

Defined cases: null is the empty text. Spans are code points, end exclusive, leftmost and
non-overlapping in each kind. Very long texts are searched whole, one at a time. Repeated rows each keep a row. Other columns are ignored
(`redacted` keeps them as they are, of whatever type). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filled, ship, text_steps, tidied

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, private boolean"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried from its start only: what fails there fails further on
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each "@": to the left the run of local characters, though not into the match before."""
    out, floor = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            floor = m.end()
    return out


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in the text as it stands."""
    found = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m.group().split("."))):
                found["ip"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found["phone"].append(m.span())
    return found


# --- transducers -----------------------------------------------------------------------------------------------------

#: Look-alikes of ASCII characters: Cyrillic and Greek letters, signs and dashes (fixed values).
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαονρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSaovpuABEZHIKMNOPTYX"))
LOOKALIKES |= {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "﹫": "@", " ": " ", " ": " ", " ": " "}
LOOKALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
_LOOKALIKE = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_GAP = r"\s*+[,.-]?+\s*+"
_DIGIT_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:(?:plus|\+){_GAP})?{_DIGIT_WORD}(?:{_GAP}(?:{_DIGIT_WORD}|[0-9])(?![A-Za-z]))+(?![A-Za-z0-9])", re.I)
_DIGIT_PIECE = re.compile(rf"plus|{_DIGIT_WORD}|[\s,.-]+", re.I)
#: Single characters with a blank after (before) each, up to (from) an "@".
_SPACED_LEFT = re.compile(r"(?<!\S)(?<!\s[A-Za-z0-9._%+-][ ])(?:[A-Za-z0-9._%+-][ ]){2,}+(?=@)")
_SPACED_RIGHT = re.compile(r"(?<=@)(?:[ ][A-Za-z0-9.-](?!\S)){2,}")
#: What stands for a sign, with the blanks around it. Blanks are looked at from the start of their run only.
_RUN = r"(?<!\s)\s*+"
_AT = re.compile(rf"{_RUN}[\[({{<]\s*+(?:at|arroba|@)\s*+[\])}}>]\s*+|(?<!\s)\s++at\s++|(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9])|(?<!\s)\s++@\s*+|@\s++", re.I)
_DOT = re.compile(rf"{_RUN}[\[({{<]\s*+(?:dot|punkt|punto|\.)\s*+[\])}}>]\s*+|(?<!\s)\s++dot\s++|(?<=[A-Za-z0-9])_dot_(?=[A-Za-z0-9])|(?<!\s)\s++\.\s++", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_NUMBER = re.compile(r"[0-9]++")
#: What stands before numbers that are no address.
_NUMBERED = re.compile(r"(?:version|release|section|chapter|\bv|\bver)[\s.:]*\Z", re.I)
_HINT = re.compile(r"[\[({<]\s*+(?:at|arroba|dot|punkt|punto|\.|@)\s*+[\])}>]|[\s_]dot[\s_]|\s@|@\s|\s\.\s", re.I)

#: Credentials: a named value, or a value of a well-known form.
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)\s*+[:=]\s*+[\"']?+(?=[A-Za-z]*+[0-9])[A-Za-z0-9+/_.=-]{12,}+"
    r"|(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}|-----BEGIN [A-Z ]*PRIVATE KEY-----",
    re.I,
)


#: What a value's name and a well-known form hold, in lower case.
_SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "key", "auth")
_SECRET_FORMS = ("akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "-----begin ")


def secrets(text: str) -> list[tuple[int, int]]:
    """Spans of credentials. The pattern only runs on texts that hold a part of each of its alternatives."""
    folded = text.casefold()
    named = (":" in text or "=" in text) and any(x in folded for x in _SECRET_NAMES)
    if not named and not any(x in folded for x in _SECRET_FORMS):
        return []
    return [m.span() for m in _SECRET.finditer(text)]


class Traced:
    """A rewritten text and the edits that led to it, one list for each rewriting."""

    def __init__(self, text: str, layers: tuple = ()):
        self.text, self.layers = text, layers

    def rewritten(self, edits: list[tuple[int, int, str]]) -> "Traced":
        """Replace each (start, end, text), in order and without overlap; new characters stand for the whole of the old."""
        if not edits:
            return self
        parts, at, moved = [], 0, 0
        starts, ends, old = [], [], []  # of the new texts in the result, and what they stand for
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts.append(a + moved)
            moved += len(new) - (b - a)
            ends.append(b + moved)
            old.append((a, b))
            at = b
        return Traced("".join(parts) + self.text[at:], (*self.layers, (starts, ends, old)))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters that the characters from start to end stand for."""
        last = end - 1
        for starts, ends, old in reversed(self.layers):
            i, j = bisect_right(starts, start) - 1, bisect_right(starts, last) - 1
            start = start if i < 0 else old[i][0] if start < ends[i] else start - ends[i] + old[i][1]
            last = last if j < 0 else old[j][1] - 1 if last < ends[j] else last - ends[j] + old[j][1]
        return start, last + 1


def homoglyphs(t: Traced) -> Traced:
    return t.rewritten([(m.start(), m.end(), LOOKALIKES[m.group()]) for m in _LOOKALIKE.finditer(t.text)])


def spelled_digits(t: Traced) -> Traced:
    def piece(m: re.Match) -> str:
        word = m.group().lower()
        return "+" if word == "plus" else DIGIT_WORDS.get(word, "." if "." in word else "-" if "-" in word else " ")

    edits = []
    for m in _DIGIT_RUN.finditer(t.text):
        for p in _DIGIT_PIECE.finditer(t.text, m.start(), m.end()):
            new = piece(p)
            # the separator after a plus sign goes
            edits.append((p.start(), p.end(), "" if new == " " and p.start() and edits and edits[-1][2] == "+" else new))
    return t.rewritten([x for x in edits if x[0] < x[1]])


def spaced(t: Traced) -> Traced:
    edits = []
    for pattern in (_SPACED_LEFT, _SPACED_RIGHT):
        for m in pattern.finditer(t.text):
            edits += [(i, i + 1, "") for i in range(m.start(), m.end()) if t.text[i] == " "]
    return t.rewritten(sorted(edits))


def disguises(t: Traced) -> Traced:
    text = t.text
    dots = {m.start(): m.end() for m in _DOT.finditer(text)}

    def chain(at: int, part: re.Pattern) -> tuple[list[tuple[int, int]], int, int, str]:
        """From a part on: the disguised dots, how many dots in all, the end, the last part."""
        found, count, last = [], 0, ""
        while m := part.match(text, at):
            at, last = m.end(), m.group()
            if at in dots and part.match(text, dots[at]):
                found.append((at, dots[at]))
                at = dots[at]
            elif text.startswith(".", at) and part.match(text, at + 1):
                at += 1
            else:
                break
            count += 1
        return found, count, at, last

    edits, floor = [], 0
    for m in _AT.finditer(text):
        a, b = m.span()
        if a < floor or not a or text[a - 1] not in _LOCAL_CHARS:
            continue
        found, count, end, last = chain(b, _LABEL)
        bare = m.group().strip().lower() == "at"
        if count and (found or not bare) and len(last) > 1 and last.isascii() and last.isalpha():
            edits += [(a, b, "@"), *((x, y, ".") for x, y in found)]
            floor = end
    # domains after a plain "@", and four numbers, with disguised dots
    taken = {a for a, _, _ in edits}
    seen = -1
    for x in dots:
        if x <= seen or x in taken or not x:
            continue
        start = x
        while start > max(seen, 0) and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "-.")):
            start -= 1
        whole = text[start:x]
        if start and text[start - 1] == "@" and whole and whole[0] != ".":
            found, count, end, last = chain(start, _LABEL)
            if count and len(last) > 1 and last.isalpha():
                edits += [(p, q, ".") for p, q in found if p not in taken]
            seen = max(seen, end - 1)
            continue
        number = re.fullmatch(r"(?:.*[^0-9.])?((?:[0-9]+\.)*[0-9]+)", whole)
        if not number:
            continue
        first = start + number.start(1)
        found, count, end, last = chain(first, _NUMBER)
        if count == 3 and not _NUMBERED.search(text, max(0, first - 16), first):
            edits += [(p, q, ".") for p, q in found if p not in taken]
        seen = max(seen, end - 1)  # other counts are no address, nor is a part of them
    return t.rewritten(sorted(edits))


def disguised(text: str) -> Traced | None:
    """The rewritten text, or None if no transducer changes it."""
    t = Traced(text)
    if not text.isascii() and _LOOKALIKE.search(text):
        t = homoglyphs(t)
    if _DIGIT_RUN.search(t.text):
        t = spelled_digits(t)
    if " @" in t.text or "@ " in t.text:
        t = spaced(t)
    if _HINT.search(t.text):
        t = disguises(t)
    return t if t.layers else None


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and all spans with those that only show in the rewritten text."""
    base = plain(text)
    every = {k: list(v) for k, v in base.items()}
    t = disguised(text)
    if t is not None:
        for kind, spans in plain(t.text).items():
            known, at, more = base[kind], 0, []
            for span in spans:  # both lists ascend
                a, b = t.source(*span)
                while at < len(known) and known[at][1] <= a:
                    at += 1
                if (at == len(known) or b <= known[at][0]) and (not more or more[-1][1] <= a):
                    more.append((a, b))
            every[kind] = sorted(known + more)
    return base, every


def span_list(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def redact(text: str | None) -> str | None:
    """The text with a tag in place of each found identifier."""
    if not text:
        return text
    _, every = find(text)
    out, at = [], 0
    for a, b, kind in sorted([(a, b, k) for k in KINDS for a, b in every[k]] + [(a, b, "secret") for a, b in secrets(text)]):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind.upper()}>" if a >= at else ""]
        at = b
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame) -> DataFrame:
    """Identifiers of every whole text: SCHEMA. `private`: whether a span or a credential was found."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_steps(filled(batch.column(1))):
                found = [find(t) for t in texts]
                counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(span_list(b).encode()).hexdigest() for b, _ in found], pa.string())
                spans = pa.array([span_list(e) for _, e in found], pa.string())
                secret = [len(secrets(t)) for t in texts]
                private = [bool(n) or any(e.values()) for n, (_, e) in zip(secret, found)]
                more = [pa.array(secret, pa.int64()), pa.array(private, pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *counts, digest, spans, *more], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """All rows with identifiers replaced by tags; n_chars, if there, follows the text. The columns stay as they are."""
    ship(docs.sparkSession)
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_steps(batch.column(at)):
                part, clean = batch.slice(first, len(texts)), [redact(t) for t in texts]
                columns = list(part.columns)
                columns[at] = pa.array(clean, columns[at].type)
                if count is not None:
                    old = columns[count].to_pylist()
                    columns[count] = pa.array([len(c) if c is not None and c != t else n for c, t, n in zip(clean, texts, old)], columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tidied(run), docs.schema)
