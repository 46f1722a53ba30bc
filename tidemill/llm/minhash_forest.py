"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its word shingles. Equal sets are one class and enter
the search once. A forest keeps several orders of the classes: order t sorts by
its own sequence of MinHash labels, so similar classes share long prefixes. A
region of an order is the run of classes with a common prefix of at least
``base`` labels; a region with more than ``crowd`` members is cut at a deeper
prefix, as deep as the labels go, which is the adaptive depth.

Links are found in two passes:

1. Every class is compared with the leader of its region in each order (the
   smallest id under the region's adaptive prefix). That is at most one
   candidate for a class and order, however many members a region has, and it
   joins most groups at once.
2. Pairs in one component need no more evidence. What is left in each base
   region are pairs of different components. A region of at most ``crowd`` / 4 members
   compares all of those. Members of larger regions (say, texts around one
   widespread passage) are compared where they share a rare shingle: of a set of n
   shingles at threshold t, the n - ceil(t * n) + 1 first ones in any order common
   to all sets contain one of every set linked with it, so this way is exact. The
   order is by how often a shingle's slot in a table of fixed size is hit, so
   widespread shingles come last; where the first shingle that two sets share
   stands too far back in both, too few can follow, and the pair is no candidate.
   No link is lost to the leaders' choice, and a
   large group costs no square of its size.

Candidates of the second pass that met in a region are first weighed by the share
of equal labels (6 standard errors of slack), those that met on a rare shingle
are not; every link is then confirmed on full shingle sets. The depth of the base
prefix is the largest at which a pair at the threshold shares no region of any
order with probability below 1e-6. So a link is missed with a probability of about
1e-6 at the threshold, far less above it, unless both texts stand in crowded regions,
where none is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_TABLE, SPACE_WORDS, U64, Words, bounded_batches, discard, encoded, mix64, parallelism, rows_in_blocks, staged_at
from .components import components

TREES, DEPTH = 20, 6


def base_depth(threshold: float, trees: int = TREES, depth: int = DEPTH) -> int:
    return max([d for d in range(1, depth + 1) if (1 - threshold**d) ** trees < 1e-6], default=1)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and where each begins."""
    s, first = Words(texts, SPACE_WORDS, SPACE_TABLE).shingles(width)
    sets = [np.unique(s[first[i] : first[i + 1]]) for i in range(len(texts))]
    return (np.concatenate(sets) if sets else s), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _labels(sets: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """MinHash labels (texts x count); every text must have a shingle."""
    rng = np.random.default_rng(7)
    mult = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    lo, hi = (sets & U64(0xFFFFFFFF)).astype(np.uint32), (sets >> U64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, count), np.uint32)
    for j in range(count):
        v = (lo ^ flip[j]) * mult[j]
        v ^= v >> np.uint32(15)
        v += hi * mult[count - 1 - j]
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        out[:, j] = np.minimum.reduceat(v, first[:-1])
    return out


def _signer(width: int, base: int, trees: int, depth: int):
    def sign(frames):
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text"):
                texts = encoded(part["text"])
                sets, first = shingle_sets(texts, width)
                n = np.diff(first)
                full = np.flatnonzero(n)
                one, two = np.zeros(len(n), U64), np.zeros(len(n), U64)
                base_keys = np.zeros((len(n), trees), np.int64)
                deep_keys = np.zeros((len(n), trees), np.int64)
                sketch = np.zeros((len(n), trees * depth), np.uint8)
                if len(full):
                    begin = np.append(first[:-1][full], first[-1])
                    one[full] = np.add.reduceat(mix64(sets), begin[:-1])
                    two[full] = np.add.reduceat(mix64(sets ^ U64(0xA5A5A5A5A5A5A5A5)), begin[:-1])
                    lab = _labels(sets, begin, trees * depth).reshape(len(full), trees, depth)
                    sketch[full] = (lab >> np.uint32(7)).astype(np.uint8).reshape(len(full), -1)
                    key = np.broadcast_to(mix64(np.arange(trees, dtype=U64)), (len(full), trees)).copy()
                    for d in range(depth):
                        key = mix64(key * U64(31) + lab[:, :, d])
                        if d == base - 1:
                            base_keys[full] = key.view(np.int64)
                    deep_keys[full] = key.view(np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "n": n,
                        "d1": one.view(np.int64),
                        "d2": two.view(np.int64),
                        "near": list(base_keys),
                        "deep": list(deep_keys),
                        "sketch": [x.tobytes() for x in sketch],
                    }
                )

    return sign


def _similar(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs whose share of equal labels is at least ``least``, for any of the sketches of each."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        b = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), -1)
        return pd.Series((a == b).mean(axis=1))

    return (
        pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a")
        .join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
        .where(share("sa", "sb") >= least)
        .select("a", "b")
        .distinct()
    )


#: Shares of a leader's members, for different tasks; the leader goes once to each.
SHARES = 256


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs with ``100 * |A & B| >= percent * |A | B|`` on full sets, for any of the texts of each. texts: (rep, text).

    The text of a goes once to each share of its partners, not along with each.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SHARES)).cast("int").alias("share"))
    lead = dealt.select("a", "share").distinct().join(texts.withColumnRenamed("rep", "a"), "a")
    rest = dealt.join(texts.withColumnRenamed("rep", "b"), "b")
    both = lead.select("a", "share", F.lit(None).cast("long").alias("b"), "text").unionByName(rest.select("a", "share", "b", "text"))

    def check(frames):
        group, held = None, []
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text"):
                sets, first = shingle_sets(encoded(part["text"]), width)
                partner = part["b"].notna().to_numpy()
                found = []
                for i, (a, share, b) in enumerate(zip(part["a"].tolist(), part["share"].tolist(), part["b"].tolist(), strict=True)):
                    if (a, share) != group:
                        group, held = (a, share), []
                    y = sets[first[i] : first[i + 1]]
                    if not partner[i]:
                        held.append(y.copy())
                        continue
                    for x in held:
                        if len(x) and len(y):
                            at = np.searchsorted(x, y)
                            at[at == len(x)] = 0
                            same = int((x[at] == y).sum())
                            if 100 * same >= percent * (len(x) + len(y) - same):
                                found.append((a, int(b)))
                                break
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

    n = parallelism(pairs.sparkSession)
    dealt = both.repartition(n, "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return dealt.mapInPandas(check, "a long, b long")


SLOTS = 1 << 18


def _rare_shingles(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, rep, n, place): of every set the shingles at which it must meet each set linked with it, rarest first."""

    def tally(frames):
        total = np.zeros(SLOTS, np.int64)
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text"):
                sets, _ = shingle_sets(encoded(part["text"]), width)
                total += np.bincount((sets & U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slot, "n": total[slot]})

    counts = texts.select("text").mapInPandas(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    hits = np.zeros(SLOTS, np.uint32)
    hits[counts["slot"].to_numpy(np.int64)] = np.minimum(counts["n"].to_numpy(np.int64), (1 << 32) - 1)
    shared = texts.sparkSession.sparkContext.broadcast(hits)  # SLOTS numbers, whatever the input

    def emit(frames):
        often = shared.value
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text"):
                sets, first = shingle_sets(encoded(part["text"]), width)
                keys, n = [], np.diff(first)
                for i, size in enumerate(n.tolist()):
                    own = sets[first[i] : first[i + 1]]
                    order = np.lexsort((own, often[(own & U64(SLOTS - 1)).astype(np.int64)]))
                    keys.append(own[order[: size + (-percent * size // 100) + 1]] if size else own)
                count = [len(k) for k in keys]
                yield pd.DataFrame(
                    {
                        "key": np.concatenate(keys).view(np.int64),
                        "rep": np.repeat(part["rep"].to_numpy(), count),
                        "n": np.repeat(n, count),
                        "place": np.concatenate([np.arange(c) for c in count]),
                    }
                )

    return texts.mapInPandas(emit, "key long, rep long, n long, place long").distinct()


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b, rare) of rows (key, rare, rep, n, place, c) with one key, different components, and sizes and places that allow a link.

    If the key is the first shingle that two sets share, they share at most it and
    what follows it in the smaller rest; ``place`` is 0 where the key is a region.
    Sets of one size are different ones, so they share one shingle less at most.
    ``rare`` tells whether any key of the pair is a shingle.
    """
    main = (
        rows.groupBy("key", "c")
        .agg(F.count("*").alias("m"))
        .groupBy("key")
        .agg(F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("t"))
        .where("parts > 1")
        .select("key", F.col("t.c").alias("main"))
    )
    rows = rows.join(main, "key")
    minor = rows.where("c <> main").select("key", F.col("rep").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    return (
        rows.join(minor, "key")
        .where(
            f"c <> cx and (c = main or x < rep) and 100 * least(n, nx) >= {percent} * greatest(n, nx) "
            f"and {100 + percent} * least(n - place, nx - px, if(n = nx, n - 1, n)) >= {percent} * (n + nx)"
        )
        .select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"), "rare")
        .groupBy("a", "b")
        .agg(F.max("rare").alias("rare"))
    )


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, crowd: int = 32
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (columns doc_id, text; others are ignored).

    Words are runs of bytes other than white space, A-Z lower-cased; a text of
    fewer than ``width`` words is one shingle; a null or blank text has an empty
    set and is linked with nothing. Rows of one doc_id are one node: they share
    the component of any of their texts. A null doc_id takes part in nothing: its
    component is null. An empty table gives an empty result.
    """
    spark, made = docs.sparkSession, []
    bounded_batches(spark)

    def staged(df, purpose):
        out, path = staged_at(df, purpose)
        made.append(path)
        return out

    threshold = percent / 100
    base = base_depth(threshold, trees, depth)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(
        docs.mapInPandas(
            _signer(width, base, trees, depth),
            "doc_id long, n long, d1 long, d2 long, near array<long>, deep array<long>, sketch binary",
        ),
        "forest",
    )
    # equal sets: one class, named by its smallest doc_id
    classes = signed.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    member, _ = staged_at(
        signed.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").select("doc_id", "n", "rep"), "member"
    )
    # a rep may come in several rows (a repeated row); one of them stands for the class
    reps = (
        signed.join(classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "doc_id"], "left_semi")
        .withColumnRenamed("doc_id", "rep")
        .select("rep", "n", "near", "deep", "sketch")
    )
    # a set links with another one only if a shingle more, the least that differs, leaves it similar: tiny texts have no partner
    rows = reps.where(F.col("n") * (100 - percent) >= percent).select("rep", "n", F.posexplode(F.arrays_zip("near", "deep")).alias("tree", "k")).select(
        "rep", "n", F.col("k.near").alias("near"), F.col("k.deep").alias("deep")
    )
    sizes = rows.groupBy("near").agg(F.count("*").alias("size")).where("size > 1")
    rows = staged(
        rows.join(sizes, "near").withColumn("region", F.when(F.col("size") <= crowd, F.col("near")).otherwise(F.col("deep"))),
        "regions",
    )
    # pass 1: region leaders
    leaders = rows.groupBy("region").agg(F.min("rep").alias("a"))
    # a crowded region's deep cuts are tied together by its most common deep prefix' leader
    cuts = rows.where(F.col("size") > crowd).groupBy("near", "deep").agg(F.count("*").alias("c"), F.min("rep").alias("lead"))
    hubs = cuts.groupBy("near").agg(F.max(F.struct("c", -F.col("lead"))).alias("m")).select("near", (-F.col("m.col2")).alias("a"))
    first = (
        rows.join(leaders, "region")
        .select("a", F.col("rep").alias("b"))
        .unionByName(rows.where(F.col("size") > crowd).join(hubs, "near").select("a", F.col("rep").alias("b")))
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    texts = docs.withColumnRenamed("doc_id", "rep")
    first = staged(first, "leaders")
    involved = staged(rows.select("rep").distinct(), "involved")
    # a doc_id with several different texts keeps them all: a link of any of them is a link of the doc_id
    texts = texts.where("text is not null").join(involved, "rep", "left_semi").dropDuplicates(["rep", "text"])
    texts = staged(texts, "texts")
    links = staged(_confirmed(first, texts, width, percent), "links")
    # pass 2: pairs of different components, in small base regions and, of crowded ones, on rare shingles
    comp = components(links).withColumnRenamed("node", "rep")
    few = crowd // 4
    crowded = rows.where(F.col("size") > few).select("rep").distinct()
    rare = _rare_shingles(texts.join(crowded, "rep", "left_semi"), width, percent)
    keyed = (
        rows.where(F.col("size") <= few)
        .select(F.col("near").alias("key"), F.lit(False).alias("rare"), "rep", "n", F.lit(0).cast("long").alias("place"))
        .unionByName(rare.withColumn("rare", F.lit(True)))
        .join(comp, "rep", "left")
        .select("key", "rare", "rep", "n", "place", F.coalesce("component", "rep").alias("c"))
    )
    second = staged(_across(staged(keyed, "keyed"), percent).join(first, ["a", "b"], "left_anti"), "second")
    slack = 6 * (threshold * (1 - threshold) / (trees * depth)) ** 0.5
    close = _similar(second.where("not rare").select("a", "b"), reps.dropDuplicates(["rep", "sketch"]), threshold - slack)
    second = second.where("rare").select("a", "b").unionByName(close)
    more = _confirmed(second, texts, width, percent)
    links = staged(links.unionByName(more), "links")
    # rows of one doc_id with several texts tie their classes together
    ties = member.where("rep is not null and rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    final = components(links.unionByName(ties))
    discard(spark, *made)
    return member.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def op10_minhash_forest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, width=3, percent=85)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
