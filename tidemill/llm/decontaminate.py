"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (runs of letters and digits,
lower-cased; whatever else stands between words does not count). Seeds are the
runs of ``min_tile`` words that both have, found by rolling (Karp-Rabin) hashes.
Seeds in a row on one diagonal are one maximal match. Tiling then takes the
longest match of the words not yet marked, marks it in both, and repeats until
no match of ``min_tile`` words is left, so a passage whose parts stand in another
order is covered as well. A document is contaminated by an item if the tiles
cover ``coverage`` of the item's words.

The benchmark goes to the executors in blocks of bounded size; each block is one
pass over all documents.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, bounded_batches, byte_table, mix64, rows_in_blocks, rows_where, separators, staged

WORD_BREAKS = separators((0, 47), (58, 64), (91, 96), (123, 127))
WORD_TABLE = byte_table(3)


def _words(texts) -> Words:
    return Words(
        [t.lower().encode("utf-8", "surrogatepass") if t is not None else b"" for t in texts], WORD_BREAKS, WORD_TABLE
    )


def _grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, across the borders of texts too."""
    out = np.zeros(max(len(h) - width + 1, 0), U64)
    for i in range(width):
        out += h[i : i + len(out)] * (mix64(np.array([i + 77], U64))[0] | U64(1))
    return mix64(out)


class Block:
    """Benchmark items of one block, with an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], min_tile: int):
        w = _words(texts)
        self.ids = ids
        self.words = [w.hashes[w.first[i] : w.first[i + 1]] for i in range(len(ids))]
        self.index = []  # for a width: sorted seed hashes, their item and place, a bitmap of hashes
        for width in sorted({min(min_tile, len(x)) for x in self.words} - {0}):
            items = [i for i, x in enumerate(self.words) if min(min_tile, len(x)) == width]
            grams = [_grams(self.words[i], width) for i in items]
            h = np.concatenate(grams)
            item = np.repeat(items, [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(h & U64(0xFFFFF)).astype(np.int64)] = True
            self.index.append((width, h[order], item[order], place[order], bitmap))


def tiles(pairs: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds: rows (place in the item, place in the document), each ``width`` words long.

    Returns (item place, document place, length). Of equal lengths the match that
    comes first in the document, then in the item, is marked first.
    """
    order = np.lexsort((pairs[:, 0], pairs[:, 1] - pairs[:, 0]))
    p = pairs[order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p[:, 0]) != 1) | (np.diff(p[:, 1]) != 1)
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(p))) + width - 1
    heap = [(-int(n), int(p[a, 1]), int(p[a, 0])) for a, n in zip(at, runs, strict=True)]
    heapq.heapify(heap)
    origin = int(p[:, 1].min())
    item_marked = np.zeros(int(p[:, 0].max()) + width, bool)
    doc_marked = np.zeros(int(p[:, 1].max()) + width - origin, bool)
    out = []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        mine, theirs = item_marked[i : i + n], doc_marked[j - origin : j - origin + n]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], mine | theirs, [True]])))
        if len(edge) == 2 and edge[1] - edge[0] == n:
            out.append((i, j, n))
            mine[:] = theirs[:] = True
            continue
        for k, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what is left of the match goes back
            if e - k >= width:
                heapq.heappush(heap, (k - e, j + k, i + k))
    return out


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of each range of n numbers, joined."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _found(block: Block, texts, least: float) -> list[tuple[int, int, float]]:
    """(number of the text, item_id, coverage) of the items of a block that the tiles of a text cover."""
    w = _words(texts)
    found: list[tuple[int, int, float]] = []
    for width, seeds, items, places, bitmap in block.index:
        g = _grams(w.hashes, width)
        hit = np.flatnonzero(bitmap[(g & U64(0xFFFFF)).astype(np.int64)])
        lo = np.searchsorted(seeds, g[hit], "left")
        n = np.searchsorted(seeds, g[hit], "right") - lo
        hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
        doc = np.searchsorted(w.first, hit, "right") - 1
        inside = hit + width <= w.first[doc + 1]
        hit, lo, n, doc = hit[inside], lo[inside], n[inside], doc[inside]
        if not len(hit):
            continue
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for own in np.split(np.arange(len(doc)), cuts):
            d = int(doc[own[0]])
            # a seed that a text repeats counts once: what all seeds reach of an item bounds what tiles can cover
            first, at, gram = np.unique(lo[own], return_index=True, return_inverse=True)
            count = n[own[at]]
            k, of = _spread(first, count), np.repeat(np.arange(len(first)), count)
            order = np.lexsort((places[k], items[k]))
            k, of = k[order], of[order]
            new = np.flatnonzero(np.diff(items[k], prepend=-1))
            step = np.minimum(np.diff(places[k], append=0), width)
            step[np.append(new[1:], len(k)) - 1] = width
            for a, b, reach in zip(new.tolist(), [*new[1:].tolist(), len(k)], np.add.reduceat(step, new).tolist(), strict=True):
                item = int(items[k[a]])
                size = len(block.words[item])
                if reach < least * size:
                    continue
                # postings of a gram are in the order of items and places, so those of one item stand in a row
                here = np.bincount(of[a:b], minlength=len(first))
                begin = np.full(len(first), len(seeds))
                np.minimum.at(begin, of[a:b], k[a:b])
                pair = np.stack([places[_spread(begin[gram], here[gram])], np.repeat(hit[own] - w.first[d], here[gram])], 1)
                share = sum(t[2] for t in tiles(pair, width)) / size
                if share >= least:
                    found.append((d, block.ids[item], share))
    return found


def _blocks(benchmark: DataFrame, min_tile: int, block_bytes: int):
    """Broadcast blocks of the benchmark, of about ``block_bytes`` of text each; items without id or text are left out."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    if n > 1:  # a row's number deals equal rows of one item apart
        number = F.xxhash64("item_id", "text", F.monotonically_increasing_id())
        bench = staged(bench.withColumn("block", F.pmod(number, F.lit(n))), "benchmark")
    for b in range(n):
        rows = (bench.where(F.col("block") == b) if n > 1 else bench).select("item_id", "text").collect()
        rows = sorted(rows, key=lambda r: (r["item_id"], r["text"]))
        yield spark.sparkContext.broadcast(Block([r["item_id"] for r in rows], [r["text"] for r in rows], min_tile))


def leaks(docs: DataFrame, benchmark: DataFrame, *, min_tile: int = 5, coverage: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, coverage) for every document and item whose tiles cover at least ``coverage``.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. An
    item of fewer than ``min_tile`` words must occur whole; items and texts without
    words (null, empty) match nothing. Repeated rows of a document give repeated
    pairs, repeated items their own pairs. Empty tables give an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    out = None
    for block in _blocks(benchmark, min_tile, block_bytes):

        def search(frames, block=block):
            for pdf in frames:
                for part in rows_in_blocks(iter([pdf]), "text"):
                    if found := _found(block.value, part["text"], coverage):
                        ids = part["doc_id"].to_numpy()
                        who, items, shares = zip(*found, strict=True)
                        yield pd.DataFrame({"doc_id": [ids[d] for d in who], "item_id": items, "coverage": shares})

        part = rows.mapInPandas(search, "doc_id long, item_id long, coverage double")
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, min_tile: int = 5, coverage: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, whose text no item of the benchmark is found in, as of ``leaks``.

    Each row is judged where it stands: nothing is joined, so ids play no part.
    Rows with a null text stay.
    """
    bounded_batches(docs.sparkSession)
    for block in _blocks(benchmark, min_tile, block_bytes):

        def clean(texts: list, block=block) -> np.ndarray:
            ok = np.ones(len(texts), bool)
            ok[[d for d, _, _ in _found(block.value, texts, coverage)]] = False
            return ok

        docs = rows_where(docs, clean, "text")
    return docs


def judged(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, contaminated, coverage, items) for every row of ``docs``: the items found in a document of that id.

    A null doc_id is never contaminated.
    """
    found = (
        leaks(docs, benchmark, **settings)
        .groupBy("doc_id")
        .agg(F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
