"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, which are put together in another order.

Each text becomes a UTF-32 code point array. Every code point has a class (line break or not, white space or not); where neighbouring
classes tell of the end of a unit, `flatnonzero` gives the boundaries. Two hashed ranks choose boundaries, the array is sliced
there, and the pieces are encoded again. Choices hang on the seed and doc_id alone, so that a task that runs again gives the same.

Forms: `plain` is the text itself; `psm` is prefix, suffix, middle and `spm` is suffix, prefix, middle, each piece after its sentinel.
`restored` gives the text back from output and form: no sentinel is part of a text that is cut, and no sentinel begins with the end of
another, so that pieces joined with sentinels hold none but those.

Defined cases: null is the empty text; a text that is empty or holds a sentinel stays plain. A null doc_id is hashed as the empty
word. Repeated rows give repeated results. A text without a whole unit is one unit; with equal ranks the middle is empty. Texts of any length are cut whole; each is a step of
its own if it is long. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import filled, ship, text_steps, tidied

PLAIN, PSM, SPM = "plain", "psm", "spm"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _after_line_breaks(codes: np.ndarray) -> np.ndarray:
    return codes[:-1] == 10


def _before_words(codes: np.ndarray) -> np.ndarray:
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return blank[:-1] & ~blank[1:]


#: Kinds of units: for each pair of neighbouring code points, whether a unit ends between them.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "line": _after_line_breaks,
    "word": _before_words,
    "character": lambda codes: np.ones(max(0, len(codes) - 1), dtype=bool),
}


@dataclass(frozen=True)
class Rules:
    """Sentinels for prefix, suffix and middle, shares in percent of texts that are cut and of these in the order spm, unit and seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    spm_rate: int = 50
    unit: str = "line"
    seed: int = 7

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise ValueError(f"no such unit: {self.unit}")
        three = self.sentinels
        if not all(three) or any(a in b for a, b in permutations(three, 2)) or any(b.startswith(a[i:]) for a in three for b in three for i in range(1, len(a))):
            raise ValueError("sentinels must not be empty, hold or overlap each other")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def boundaries(codes: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where units begin and end: 0, each place between two units, and the length; only 0 for an empty text."""
    if not len(codes):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(UNITS[unit](codes)) + 1, [len(codes)]])


def chosen(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the hash of seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def cut(text: str, doc_id: int | None, rules: Rules) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the output of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at = boundaries(codes, rules.unit)
    n = len(at) - 1
    h1, h2, h3, h4 = chosen(doc_id, rules.seed)
    if not n or h3 % 100 >= rules.rate or any(s in text for s in rules.sentinels):
        return n, PLAIN, None, None, text
    a, b = (int(at[r]) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le", "surrogatepass") for x in (codes[:a], codes[a:b], codes[b:]))
    before, after = rules.prefix + prefix, rules.suffix + suffix
    form = SPM if h4 % 100 < rules.spm_rate else PSM
    return n, form, a, b - a, (after + before if form == SPM else before + after) + rules.middle + middle


def transformed(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every document's form and output: SCHEMA. One pass without a shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_steps(filled(batch.column(1))):
                own = ids[first : first + len(texts)]
                rows = [cut(t, i, rules) for t, i in zip(texts, own)]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), SCHEMA)


def restored(output: Column | str = "output", form: Column | str = "form", rules: Rules = Rules()) -> Column:
    """The exact text again, from output and form."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(map(re.escape, rules.sentinels)), -1)
    psm, spm = ([F.get(parts, F.lit(i)) for i in order] for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == PSM, F.concat(*psm)).when(form == SPM, F.concat(*spm)).otherwise(output)


def digests(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Units, form and hashes of the output and of the text restored from it."""
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return transformed(docs, rules).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(rules=rules)).alias("restored_sha256"))
