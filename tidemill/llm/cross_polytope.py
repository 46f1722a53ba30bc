"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are put on the unit sphere and turned by fast pseudo-rotations (three
rounds of random signs and a Hadamard transform); the nearest signed axis is one
letter of a hash. A table's hash has several letters, each of a rotation of its
own, the last ones over fewer axes, so that there are about as many buckets as
vectors, however many there are. Every vector is in one bucket of each of
``tables`` tables.

A query looks into the ``probes`` buckets, of all tables together, whose axes have
the largest summed coordinates of the turned query: after its own bucket those
that it misses by the smallest margins. How many are needed is measured: up to
``trials`` vectors (the bound of the sample) are compared with all, and ``probes`` is
what finds the share ``recall`` of their k nearest. Candidates are ranked by
their exact distance, on the original vectors in double precision.

Equal vectors are one class. No more than k + 1 of them, the smallest ids, can be
in any answer (the ids decide ties, and a query skips only itself), so the index
holds those, which is exact. Vectors and queries meet by table and first letter.
Groups are split on both sides: a task holds at most about ``part`` vectors, and
streams its queries past them. It keeps the k nearest of each query, so neither a
common bucket nor the pairs within it become rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged


def rotations(dim: int, count: int, seed: int = 5) -> np.ndarray:
    """Random signs (count x 3 x padded dimension)."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], (count, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of the rows."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def letters_for(n: int, dim: int) -> list[int]:
    """Axes (without signs) of each letter of a table's hash: together about n / 2 buckets."""
    size = 1 << max(1, (dim - 1).bit_length())
    out, left = [size], n / (4 * size)
    while left >= 2 and len(out) < 4:
        out.append(min(size, 1 << int(np.log2(left))))
        left /= 2 * out[-1]
    return out


class Index:
    """The hash of all tables: signs of every letter, and how many axes it has."""

    def __init__(self, dim: int, n: int, tables: int, seed: int = 5):
        self.tables, self.axes = tables, letters_for(n, dim)
        self.signs = rotations(dim, tables * len(self.axes), seed)

    def _turned(self, x: np.ndarray):
        unit = np.zeros((len(x), self.signs.shape[2]))
        unit[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
        for t in range(self.tables):
            own = self.signs[t * len(self.axes) : (t + 1) * len(self.axes)]
            yield [hadamard(hadamard(hadamard(unit * a) * b) * c)[:, :n] for (a, b, c), n in zip(own, self.axes, strict=True)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bucket of every vector in each table (vectors x tables); the first letter leads. Axis 2i is +i, 2i + 1 is -i."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t, turned in enumerate(self._turned(x)):
            for y in turned:
                i = np.abs(y).argmax(1)
                out[:, t] = out[:, t] * (2 * y.shape[1]) + 2 * i + (y[np.arange(len(x)), i] < 0)
        return out

    def probed(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(table, bucket) of the ``probes`` best buckets of every vector, best first (fewer if there are no more)."""
        scores, codes = [], []
        for turned in self._turned(x):
            best, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for y in turned:  # the best of all words have their beginnings among the best beginnings
                each = np.stack([y, -y], 2).reshape(len(x), -1)
                best = (best[:, :, None] + each[:, None]).reshape(len(x), -1)
                code = (code[:, :, None] * each.shape[1] + np.arange(each.shape[1])).reshape(len(x), -1)
                if best.shape[1] > probes:
                    at = np.argpartition(-best, probes - 1, 1)[:, :probes]
                    best, code = np.take_along_axis(best, at, 1), np.take_along_axis(code, at, 1)
            scores.append(best)
            codes.append(code)
        table = np.repeat(np.arange(self.tables), [c.shape[1] for c in codes])
        best, code = np.concatenate(scores, 1), np.concatenate(codes, 1)
        if best.shape[1] > probes:
            at = np.argpartition(-best, probes - 1, 1)[:, :probes]
            best, code, table = np.take_along_axis(best, at, 1), np.take_along_axis(code, at, 1), table[at]
        else:
            table = np.broadcast_to(table, code.shape)
        order = np.argsort(-best, 1, kind="stable")
        return np.take_along_axis(table, order, 1), np.take_along_axis(code, order, 1)


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, float) for b in column])


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((v - q) ** 2).sum(1))


def _usable(column: str):
    """Vectors that take part: not null, not empty, finite components, not all zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def probes_for(data: DataFrame, index: Index, k: int, recall: float, trials: int, most: int = 1 << 14) -> int:
    """How many buckets find the share ``recall`` of the k nearest of up to ``trials`` vectors, as one pass over all vectors measures.

    data: (vec_id, v as binary doubles).
    """
    rows = data.orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(trials).collect()
    ids, queries = [r["vec_id"] for r in rows], _matrix([r["v"] for r in rows])

    def nearest(frames):
        held = [(np.empty(0), np.empty(0, np.int64), np.empty((0, queries.shape[1])))] * len(queries)
        for pdf in frames:
            v, own = _matrix(pdf["v"]), pdf["vec_id"].to_numpy()
            for i, q in enumerate(queries):
                d = _distances(q, v)
                keep = np.flatnonzero(own != ids[i])
                keep = keep[np.argsort(d[keep], kind="stable")[:k]]
                d, o, x = (np.concatenate(p) for p in zip(held[i], (d[keep], own[keep], v[keep]), strict=True))
                best = np.argsort(d, kind="stable")[:k]
                held[i] = d[best], o[best], x[best]
        for i, (d, _, x) in enumerate(held):
            if len(d):
                yield pd.DataFrame({"i": i, "d": d, "v": [r.tobytes() for r in x]})

    found = data.mapInPandas(nearest, "i int, d double, v binary")
    best = W.partitionBy("i").orderBy("d")
    found = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).toPandas()
    if not len(found):
        return 1
    near = index.codes(_matrix(found["v"]))
    ranks = np.full(len(found), most)
    for i, part in found.groupby("i"):
        table, code = (x[0] for x in index.probed(queries[i : i + 1], most))
        place = dict(zip(zip(table.tolist(), code.tolist(), strict=True), range(len(code)), strict=True))
        for row in part.index:
            ranks[row] = min((place.get((t, int(c)), most) for t, c in enumerate(near[row])), default=most)
    return int(min(most, np.quantile(ranks, recall, method="higher") + 1))


def neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, *, tables: int = 32, recall: float = 0.93, trials: int = 64, part: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean distance; ties to the smaller vec_id.

    vectors and queries: (vec_id, embedding); other columns are ignored. A query's
    own id is no candidate of it. Null vectors, ids, all-zero vectors and those
    with null or non-finite components take no part; neither do vectors of another
    length than the most common one. Rows of one id and different vectors count
    with the nearest; repeated rows count once. Queries that find fewer than k are
    compared with all vectors. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    shape = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & _usable("v")
    )
    base, asked = shape(vectors), shape(queries)
    sizes = base.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["n"]

    def packed(frames):
        for pdf in frames:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": [np.asarray(v, float).tobytes() for v in pdf["v"]]})

    pack = lambda df: df.where(F.size("v") == dim).mapInPandas(packed, "vec_id long, v binary")
    # of equal vectors the k + 1 smallest ids; Spark limits the groups before it shuffles them
    same = W.partitionBy("v").orderBy("vec_id")
    few = pack(base).withColumn("rn", F.dense_rank().over(same)).where(F.col("rn") <= k + 1)
    data = staged(few.select("vec_id", "v").distinct(), "vectors")
    asked = pack(asked).distinct()
    index = Index(dim, sizes[0]["c"], tables)
    probes = probes_for(data, index, k, recall, trials)
    letter = 2 * index.axes[0]
    rest = int(np.prod([2 * n for n in index.axes[1:]], dtype=np.int64))

    def file(frames):
        for pdf in frames:
            code = index.codes(_matrix(pdf["v"]))
            b = code // rest + np.arange(tables) * letter
            yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), tables), "v": np.repeat(pdf["v"].to_numpy(), tables), "b": b.reshape(-1), "words": [w.tobytes() for w in (code % rest).reshape(-1, 1)]})

    def look(frames):
        for pdf in frames:
            for begin in range(0, len(pdf), 16):
                some = pdf.iloc[begin : begin + 16]
                table, code = index.probed(_matrix(some["v"]), probes)
                out = []
                for i, v, t, c in zip(some["vec_id"].tolist(), some["v"], table, code, strict=True):
                    b = c // rest + t * letter
                    order = np.argsort(b, kind="stable")
                    cuts = np.flatnonzero(np.diff(b[order])) + 1
                    out += [(i, v, int(b[own[0]]), (c[own] % rest).tobytes()) for own in np.split(order, cuts)]
                yield pd.DataFrame(out, columns=["vec_id", "v", "b", "words"])

    kind = "vec_id long, v binary, b long, words binary"
    filed, looks = data.mapInPandas(file, kind), staged(asked.mapInPandas(look, kind), "looks")
    # how often each group is split: a number for each table and first letter, of which there are a fixed number
    count = lambda df: {r["b"]: r["c"] for r in df.groupBy("b").agg(F.count("*").alias("c")).collect()}
    held = count(data.mapInPandas(lambda frames: (f[["b"]] for f in file(frames)), "b long"))
    split = [(b, -(-n // part), -(-c // (8 * part))) for b, c in count(looks).items() if (n := held.get(b))]
    if not split:
        return spark.createDataFrame([], schema)
    table = F.broadcast(spark.createDataFrame(split, "b long, parts int, shares int"))  # tables x axes rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    filed = filed.join(table, "b").select("b", mine("parts").alias("part"), every("shares").alias("share"), F.lit(0).alias("side"), "vec_id", "v", "words")
    looks = looks.join(table, "b").select("b", every("parts").alias("part"), mine("shares").alias("share"), F.lit(1).alias("side"), "vec_id", "v", "words")

    def search(frames):
        group, here, best, n_best = None, [], {}, 0
        for pdf in frames:
            keys = pdf["b"].to_numpy() * np.int64(1 << 40) + pdf["part"].to_numpy() * np.int64(1 << 20) + pdf["share"].to_numpy()
            for own in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(keys)) + 1):
                rows = pdf.iloc[own]
                if keys[own[0]] != group:
                    group, here, ready = keys[own[0]], [], None
                side = rows["side"].to_numpy()
                if (side == 0).any():
                    here.append(rows[side == 0])
                asks = rows[side == 1]
                if not len(asks) or not here:
                    continue
                if ready is None:
                    every = pd.concat(here)
                    word = np.frombuffer(b"".join(every["words"]), np.int64)
                    order = np.argsort(word, kind="stable")
                    ready = word[order], every["vec_id"].to_numpy()[order], _matrix(every["v"])[order]
                word, ids, v = ready
                for q, raw, words in zip(asks["vec_id"].tolist(), asks["v"], asks["words"], strict=True):
                    w = np.frombuffer(words, np.int64)
                    lo, hi = np.searchsorted(word, w, "left"), np.searchsorted(word, w, "right")
                    n = hi - lo
                    if not n.sum():
                        continue
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    d = _distances(np.frombuffer(raw, float), v[at])
                    mine = ids[at]
                    d, mine = d[mine != q], mine[mine != q]
                    d, mine = _closest(d, mine, k, best.get(q))
                    n_best += len(d) - (len(best[q][0]) if q in best else 0)
                    best[q] = d, mine
            if n_best > 1 << 20:
                yield _answers(best)
                best, n_best = {}, 0
        if best:
            yield _answers(best)

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (
        filed.unionByName(looks)
        .repartition(n_parts, "b", "part", "share")
        .sortWithinPartitions("b", "part", "share", "side")
        .mapInPandas(search, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
    )
    rank = W.partitionBy("query_id").orderBy("score", "vec_id")
    found = staged(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k), "found")
    few = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    rows = found.select("query_id", "rank", "vec_id", "score")
    if few.isEmpty():
        return rows
    whole = _scanned(data, staged(few, "few"), k)
    return rows.join(whole.select("query_id").distinct(), "query_id", "left_anti").unionByName(whole)


def _closest(d: np.ndarray, ids: np.ndarray, k: int, more: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids, each once, nearest first."""
    if more is not None:
        d, ids = np.concatenate([d, more[0]]), np.concatenate([ids, more[1]])
    order = np.lexsort((ids, d))
    if len(order) > 4 * k:  # copies of an id are few
        order = order[: 4 * k]
    d, ids = d[order], ids[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return d[first], ids[first]


def _answers(best: dict) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.repeat(list(best), [len(d) for d, _ in best.values()]), "vec_id": np.concatenate([i for _, i in best.values()]), "score": np.concatenate([d for d, _ in best.values()])})


def _scanned(data: DataFrame, few: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """Exact answers of queries that met fewer than k vectors: all vectors, for blocks of queries."""
    n = few.count()
    blocks = -(-n // block)
    out = None
    for b in range(blocks):
        rows = few.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()

        def scan(frames, rows=rows):
            best: dict = {}
            for pdf in frames:
                v, ids = _matrix(pdf["v"]), pdf["vec_id"].to_numpy()
                for q, raw in rows:
                    d = _distances(np.frombuffer(raw, float), v)
                    best[q] = _closest(d[ids != q], ids[ids != q], k, best.get(q))
            if best:
                yield _answers(best)

        found = data.mapInPandas(scan, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        out = found if out is None else out.unionByName(found)
    rank = W.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_cross_polytope(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(rows, rows.where("vec_id % 100 = 0"))
