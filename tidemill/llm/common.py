"""Shared helpers: storage all executors see, and vectorised text primitives.

Text primitives work on a whole Arrow batch at once: the texts are joined into
one byte (or code-point) array, so the cost of a document is a few numpy passes
and not a Python loop over its words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
NONE = np.int32(-1)


# ---------------------------------------------------------------- shared storage
def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in tests, is a
    local temporary folder used and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jdir.get() if jdir.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """``df`` written once to shared storage and read from the files, and where they are.

    Cuts the lineage with a table that survives the loss of any executor, and
    keeps several readers from recomputing an expensive frame. The shuffle files
    of the write are of no more use; the collection lets Spark delete them.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, purpose: str) -> DataFrame:
    return staged_at(df, purpose)[0]


def bucketed(df: DataFrame, purpose: str, key: str) -> DataFrame:
    """As ``staged``, in buckets of ``key``: joins and aggregations on it do not deal these rows again."""
    spark = df.sparkSession
    path, name = shared_dir(spark, purpose), f"tidemill_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parallelism(spark), key).option("path", path).saveAsTable(name)
    spark.sparkContext._jvm.System.gc()
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # an external table: its files stay
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no frame still to be computed reads."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Limit what a Python worker gets at once, by rows and by bytes, for texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def trim() -> None:
    """Give memory that is free within the allocator back to the system; workers live on between tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def rows_in_blocks(frames: Iterator[pd.DataFrame], column: str, limit: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """Re-cut Arrow batches so that a block holds about ``limit`` characters of ``column``."""
    for pdf in frames:
        if not len(pdf):
            continue
        sizes = pdf[column].map(lambda t: len(t) if t is not None else 0).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        for part in np.split(np.arange(len(pdf)), cuts):
            if len(part):
                yield pdf.iloc[part[0] : part[-1] + 1]
        trim()


def rows_where(df: DataFrame, keep: Callable[[list], np.ndarray], column: str, limit: int = 1 << 19) -> DataFrame:
    """Rows of ``df``, all columns, for whose texts ``keep`` is true; it gets blocks of about ``limit`` characters.

    The rows stay Arrow batches throughout; only the texts become Python's.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            cuts = np.flatnonzero(np.diff(np.cumsum([len(t) if t is not None else 0 for t in texts]) // limit)) + 1
            edges = [0, *cuts.tolist(), len(texts)]
            mask = [keep(texts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
            if mask:
                yield batch.filter(pa.array(np.concatenate(mask)))
            trim()

    return df.mapInArrow(run, df.schema)


# ---------------------------------------------------------------- hashing
def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers modulo 2**64 of the hash base, and of its inverse."""
    have = len(_powers[0])
    if have < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, U64(b))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end], whatever the place of the span."""
    p, q = powers(len(values) + 1)
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * q[starts])


class Table:
    """Open-addressing map from non-zero 64-bit keys to int32, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(len(keys), 1)).bit_length() + 1)
        self.keys, self.values = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, NONE)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == 0
            put = left[free][::-1]
            self.keys[slot[put]] = keys[put]
            self.values[slot[put]] = values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        left = np.flatnonzero((found != keys) & (found != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != 0)]
        return out


# ---------------------------------------------------------------- words of many texts
def joined(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by ``sep``, and where each begins (one more entry for the end)."""
    buf = np.frombuffer(sep.join(texts) + sep, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(sep)
    return buf, np.concatenate([[0], np.cumsum(sizes)])


class Words:
    """Words of a list of texts: hashes, byte spans, and the first word of each text."""

    def __init__(self, texts: list[bytes], separator: np.ndarray, table: np.ndarray):
        self.buf, self.at = joined(texts)
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[:-1] = ~separator[self.buf]
        step = np.diff(inside, prepend=0)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.hashes = span_hashes(table[self.buf], self.starts, self.ends) if len(self.starts) else np.empty(0, U64)
        self.first = np.searchsorted(self.starts, self.at)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words of a text (a shorter text: its whole sequence), and each text's first.

        Returns (hashes, first) with ``first`` one longer than the number of texts.
        """
        n = np.diff(self.first)
        h, total = self.hashes, len(self.hashes)
        mult = [mix64(np.array([i + 1], U64))[0] | U64(1) for i in range(width)]
        out = np.zeros(max(total - width + 1, 0), U64)
        for i, m in enumerate(mult):
            out += h[i : i + len(out)] * m
        out = mix64(out)
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        first = np.concatenate([[0], np.cumsum(count)])
        if (n >= width).all():
            keep = np.ones(total, bool)
            ends = self.first[1:]
            for i in range(1, width):
                keep[ends - i] = False
            return out[keep[: len(out)]] if total else out, first
        res = np.empty(first[-1], U64)
        for d in range(len(n)):
            a, k = self.first[d], n[d]
            if k >= width:
                res[first[d] : first[d + 1]] = out[a : a + k - width + 1]
            elif k:
                with np.errstate(over="ignore"):
                    res[first[d]] = mix64(np.array([sum(int(x) * int(m) for x, m in zip(h[a : a + k], mult)) % (1 << 64) + int(k)], U64))[0]
        return res, first


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def folded(table: np.ndarray) -> np.ndarray:
    """The table with A-Z treated as a-z."""
    out = table.copy()
    out[65:91] = out[97:123]
    return out


#: Words of ``[^\x20\x09-\x0D]+`` with A-Z folded.
SPACE_WORDS = separators((0x20, 0x20), (0x09, 0x0D))
SPACE_TABLE = folded(byte_table(1))


def encoded(column: pd.Series) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in column]
