"""Helpers that the corpus operators share: shared storage, whole-text buffers, hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: The same for steps that make many times as many bytes of arrays, which each worker holds beside its executor's JVM.
WIDE_STEP_BYTES = 1 << 18
#: Words that a worker keeps the hashes of, and the longest such word.
KEPT_WORDS, LONGEST_WORD = 100_000, 48


BATCH_BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession, batch: int = BATCH_BYTES) -> None:
    """Send this package to the executors once for each application, unless their Python path has it already.

    Batches of whole texts are cut at `batch` bytes where the session has the default of 64 MB (or, for smaller ones, BATCH_BYTES); a longer text is a batch of its own.
    """
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH_BYTES_KEY).rstrip("b") in {str(64 << 20), str(max(batch, BATCH_BYTES))}:
        spark.conf.set(BATCH_BYTES_KEY, str(batch))
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(app)
    archive = Path(tempfile.mkdtemp(prefix="clickloom-")) / "clickloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "clickloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the session names none, a local master (tests) gets a temporary one; on a
    cluster, whose executors do not share the driver's folders, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clickloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


_TABLES: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there and survives lost executors.

    Operators `discard` the tables that their result does not need; the others stay until `release`, at the latest the program's end.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/clickloom-{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(release, spark)
    _TABLES.add(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._path = path
    return table


def has_rows(df: DataFrame) -> bool:
    """Whether there is a row, by one job: `take` asks an empty table's partitions in job after job, which the driver keeps the figures of."""
    return df.limit(1).count() > 0


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a query's shuffle files when the query has ended; its result has to be written. The session's setting is put back."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for files that tasks write themselves; it goes with the written tables."""
    if not _TABLES:
        atexit.register(release, spark)
    path = f"{shared_dir(spark)}/clickloom-{name}-{uuid.uuid4().hex}"
    _TABLES.add(path)
    return path


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_path", None)
        if path in _TABLES:
            _delete(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all tables that operators have written. Call it when their results have been used."""
    for path in list(_TABLES):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _TABLES.discard(path)
    if spark.sparkContext._jsc is not None:  # else the application has ended, and the folder's owner clears it
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def steps(lengths: np.ndarray, most: int = STEP_BYTES):
    """Row ranges (a, b) of at most `most` units in sum, or of one row."""
    ends = np.cumsum(lengths)
    a, n = 0, len(lengths)
    while a < n:
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield a, b
        a = b


def filled(column: pa.Array) -> pa.Array:
    """A text column with null as the empty text."""
    return pc.fill_null(column, "")


def text_steps(column: pa.Array, most: int = STEP_BYTES):
    """(first row, texts) in steps of bounded size."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for a, b in steps(lengths, most):
        yield a, column.slice(a, b - a).to_pylist()


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with a space around each; the first and the end byte of each text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1)
    return data, ends - lengths, ends


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    z = z ^ (z >> U64(30))
    z = z * U64(0xBF58476D1CE4E5B9)
    z ^= z >> U64(27)
    z *= U64(0x94D049BB133111EB)
    z ^= z >> U64(31)
    return z


class _WordHashes(dict):
    """64-bit values of words; the common ones are kept, and it starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8, person=b"word").digest(), "little")
        if len(word) <= LONGEST_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


_HASHES = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The first 64 bits of a BLAKE2b digest of each word."""
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=U64, count=len(words))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def text_word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space; those of a long text are made part by part."""
    out, a = [], 0
    while a < len(data):
        m = _SPACE.search(data, a + STEP_BYTES)
        b = m.start() if m else len(data)
        out.append(word_hashes(data[a:b].split()))
        a = b
    return np.concatenate(out) if out else np.empty(0, dtype=U64)


def tidy() -> None:
    """Empty the worker's cache of words and give its free memory back to the system."""
    _HASHES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, and `tidy` after each partition: idle workers stand beside the JVM of later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def shingles_of(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes: their sum with an odd factor for each place, scrambled."""
    last = len(words) - n + 1
    if last <= 0:
        return np.empty(0, dtype=U64)
    full = words[:last] * _FACTORS[0]
    for j in range(1, n):
        full += words[j : last + j] * _FACTORS[j]
    return mix(full)
