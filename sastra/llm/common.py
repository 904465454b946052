"""Shared pieces of the training-data operators: lineage cuts, text batches and vectorised word hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir
from ..functions.workers import ship

__all__ = ["cut", "shared_dir"]

#: Bytes of text that a Python worker turns into arrays at once; a longer text is a batch of its own.
BATCH_BYTES = 1_000_000
#: Rows that travel to a Python worker at once.
BATCH_ROWS = 512

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, made from ``name`` (names compare without case, as Spark's do)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let the driver drop finished plans, so that executors delete their shuffle files now and not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def store(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a columnar table in the shared folder and read it back (columns prune, filters push down)."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`store` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, as a text may be long; and let Python workers find this package.

    Plans read the setting when they run, which is after the operator returns, so it can't be put back; a smaller value of the session's stays.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def lower_ascii(col):
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(col):
    """crc32 of the id's decimal text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


# ---------------------------------------------------------------- vectorised words


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds); every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BATCH_BYTES + BATCH_ROWS + 2)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """The words of a few texts as arrays.

    ``data`` holds all bytes, texts parted by a blank; word w spans ``start[w]:end[w]``; text t owns the
    words ``first[t]:first[t + 1]``.
    """

    def __init__(self, texts: list[bytes], in_word: np.ndarray, fold: np.ndarray):
        self.data = fold[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = in_word[self.data]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, begin)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def sums(self) -> np.ndarray:
        """Prefix sums from which the hash of any span is had by :meth:`spans`."""
        up, _ = _power(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        _, down = _power(len(self.data) + 1)
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.spans(self.sums(), self.start, self.end)


def byte_set(kept) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(kept)] = True
    return out


IDENTITY = np.arange(256, dtype=np.uint8)
FOLD = IDENTITY.copy()
FOLD[65:91] += 32
#: Words between blanks, and words of letters (every byte of a non-ASCII character counts as a letter).
NOT_SPACE = ~byte_set(SPACES)
LETTERS = byte_set([*range(97, 123), *range(65, 91), *range(128, 256)])


def slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """The texts (null: empty) of a column as UTF-8, in runs of about ``limit`` bytes and ``BATCH_ROWS`` rows at most: (from, to, texts)."""
    texts: list[bytes] = []
    at = size = 0
    for i, value in enumerate(column):
        x = value.as_buffer().to_pybytes() if value.is_valid else b""
        if texts and (size + len(x) > limit or len(texts) >= BATCH_ROWS):
            yield at, i, texts
            at, size, texts = i, 0, []
        texts.append(x)
        size += len(x)
    if texts:
        yield at, len(column), texts
    pa.default_memory_pool().release_unused()


def fetch(df: DataFrame) -> pa.Table:
    """A result of proven size, on the driver."""
    return df.toArrow()
