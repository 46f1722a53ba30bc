"""op10 against all pairs, by brute force; components; edge cases."""

import random
import re

import pytest

from tidemill.llm import minhash_forest
from tidemill.llm.components import components
from tidemill.llm.minhash_forest import base_depth, near_duplicates


def brute(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets[i] = s
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out, passage = [], [word() for _ in range(30)]
    for size in (4, 12, 40, 80):
        base = [word() for _ in range(size)]
        out.append(base)
        for _ in range(30):  # a star of near copies, and chains
            copy = list(rng.choice(out[-5:]) if rng.random() < 0.3 else base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    out += [passage + [word() for _ in range(rng.randint(1, 8))] for _ in range(60)]  # one passage, own endings
    texts = [" ".join(w) for w in out]
    texts += [texts[0].upper(), texts[5], "", " \n", None, "one", "One", "one two", "é É"]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width, percent, crowd", [(3, 85, 32), (5, 80, 2), (3, 85, 4)])
def test_equals_brute_force(spark, width, percent, crowd):
    docs = corpus(width + crowd)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id long, text string, near string, component_id long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, width=width, percent=percent, crowd=crowd).collect()}
    assert got == brute(docs, width, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_tiny_texts(spark, monkeypatch, percent):
    """Sets of 1 to 16 shingles: those that can have no partner are never compared, the others are linked as by brute force."""
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(16)]
    docs = list(enumerate(" ".join(sorted(rng.sample(words, rng.randint(1, 16)))) for _ in range(250)))
    asked, confirmed = [], minhash_forest._confirmed
    monkeypatch.setattr(minhash_forest, "_confirmed", lambda pairs, *rest: asked.append(pairs.count()) or confirmed(pairs, *rest))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=1, percent=percent, crowd=8).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, 1, percent)
    few = [(i, t) for i, t in docs if len(t.split()) <= percent // (100 - percent) - (percent == 80)]
    asked.clear()
    near_duplicates(spark.createDataFrame(few, "doc_id long, text string"), width=1, percent=percent, crowd=8).collect()
    assert sum(asked) == 0 and len(few) > 30


def test_rare_shingles_need_no_sketch(spark, monkeypatch):
    """Without region leaders and without any similar sketches, rare shingles alone find all links."""
    keep = minhash_forest.staged_at
    monkeypatch.setattr(minhash_forest, "staged_at", lambda df, name: keep(df.limit(0) if name == "leaders" else df, name))
    monkeypatch.setattr(minhash_forest, "_similar", lambda pairs, *_: pairs.limit(0))
    docs = corpus(5)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=5, percent=80, crowd=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, 5, 80)


def test_repeated_rows_nulls_and_empty(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    df = spark.createDataFrame([(5, a), (5, a), (7, a), (8, b), (5, b), (None, a), (9, None)], "doc_id long, text string")
    rows = near_duplicates(df, width=3, percent=85).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in rows) == [(-1, None), (5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}


def test_depth():
    assert base_depth(0.85) == 4 and base_depth(0.8) == 3


@pytest.mark.parametrize("over", [0, 1])
def test_texts_at_the_threshold(spark, over):
    """300 pairs at exactly 85 of 100 shingles are linked, all of them; pairs at 84 of 100 are not."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = [f"p{i}w{k}x{rng.randrange(10**6)}" for k in range(100)]
        shared, rest = words[: 85 - over], words[85 - over :]
        a, b = shared + rest[:7], shared + rest[7:]
        for j, own in enumerate((a, b)):
            rng.shuffle(own)
            rows.append((2 * i + j, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=85).collect()}
    assert all(got[2 * i + 1] == 2 * i + over for i in range(300))


def test_a_hub_of_many_members_and_long_texts(spark, monkeypatch):
    """One leader with more members than a share holds; texts of 50,000 words."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = [(i, " ".join(base[:-1] + [word()])) for i in range(1300)]
    long = [word() for _ in range(50_000)]
    rows += [(5000, " ".join(long)), (5001, " ".join([*long[:-5], "x"])), (5002, " ".join(long[:25_000]))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert {got[i] for i in range(1300)} == {0} and (got[5000], got[5001], got[5002]) == (5000, 5000, 5002)
