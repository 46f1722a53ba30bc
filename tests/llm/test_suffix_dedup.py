"""op1 against every window, by brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidemill.llm import suffix_dedup
from tidemill.llm.suffix_dedup import anchors, blind_trie, deep_shallow, repeated_substrings


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for b in raw:
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                edge[s] += 1
                edge[s + length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6))) for _ in range(n))
    passage, base = words(20), words(60)
    out = [words(40) + passage + words(rng.randint(1, 30)) for _ in range(25)]  # one passage in many contexts
    out += [base.replace(base[k * 9 : k * 9 + 3], "zzz", 1) for k in range(12)]  # near copies
    out += [base, base, passage, passage * 3, "x" * 500, "ab" * 200, "", None, "short", words(5)]
    return out


@pytest.mark.parametrize("length, crowd", [(40, 2048), (40, 3), (9, 5), (100, 2)])
def test_equals_brute_force(spark, length, crowd):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = repeated_substrings(df, length=length, crowd=crowd).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute(texts, length)
    assert all(r["n_repeated"] == r["n_removed"] for r in got)


@pytest.mark.parametrize("length, passage, crowd", [(40, 20, 2048), (40, 11, 3), (100, 30, 2)])
def test_two_lengths_equal_brute_force(spark, length, passage, crowd):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = repeated_substrings(df, length=length, passage=passage, crowd=crowd, kept_as="binary", carry=[]).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute(texts, length)
    assert [r["n_repeated"] for r in got] == [r[1] for r in brute(texts, passage)]
    for r, t in zip(got, texts, strict=True):
        raw, at = (t or "").encode(), 0
        kept = b""
        for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True):
            kept, at = kept + raw[at:a], b
        assert kept + raw[at:] == bytes(r["kept"]) and r["was_null"] == (t is None)


def test_blocks_told_alike_make_no_windows(spark, monkeypatch):
    """A passage in ever more contexts, dealt to a task for every three: what is compared window by window are the few at its ends."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6))) for _ in range(n))
    passage, made, staged = words(80), [], suffix_dedup.staged
    monkeypatch.setattr(suffix_dedup, "staged", lambda df, purpose: (made.append((purpose, out := staged(df, purpose))), out)[1])
    texts = [words(12) + passage + words(12) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeated_substrings(df, length=100, crowd=3).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute(texts, 100)
    rows = next(out for purpose, out in made if purpose == "windows").count()
    assert rows < 40 * len(texts), rows  # a text has about 250 windows of the passage


def test_very_long_texts(spark, monkeypatch):
    """Windows at the borders of pieces, in texts of several pieces."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    rng = random.Random(8)
    long = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = long(6000), long(9000)
    texts = [a + b[1700:2300], b, long(50), a[900:1100] + long(700) + a[2900:3300], "z" * 4000]
    raw = [t.encode() for t in texts]
    got = suffix_dedup.anchors(raw, (60, 90), 30)
    for i, t in enumerate(raw):
        own = got[got["i"] == i]
        for k, length in enumerate((60, 90)):
            covered = [w for x, y in zip(own[f"a{k}"], own[f"b{k}"], strict=True) for w in range(x, y + 1)]
            assert covered == list(range(max(0, len(t) - length + 1)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [long(300_000)])], "doc_id long, text string")
    rows = repeated_substrings(df, length=90, passage=60).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows[:-1]] == brute(texts, 90) and rows[-1]["n_removed"] == 0
    assert [r["n_repeated"] for r in rows[:-1]] == [r[1] for r in brute(texts, 60)]


def test_text_and_spans(spark):
    df = spark.createDataFrame([(1, "a" * 10 + "0123456789" * 3), (1, "b" * 7 + "0123456789" * 3), (None, "c")], "doc_id long, text string")
    rows = repeated_substrings(df, length=20, kept_as="binary").collect()
    assert sorted((bytes(r["kept"]), list(r["spans"])) for r in rows) == [(b"a" * 10, [10, 40]), (b"b" * 7, [7, 37]), (b"c", [])]
    assert repeated_substrings(df.limit(0), length=20).count() == 0
    cut = spark.createDataFrame([(1, "aé" + "0123456789" * 3 + "éz"), (2, "b\u00e9" + "0123456789" * 3 + "\u00e8y")], "doc_id long, text string")
    raw = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"]) for r in repeated_substrings(cut, length=20, kept_as="binary").collect()}
    assert raw == {1: (b"a\xa9z", 33), 2: (b"b\xa8y", 33)}
    assert {r["doc_id"]: r["kept"] for r in repeated_substrings(cut, length=20, kept_as="string").collect()} == {1: "az", 2: "by"}


def test_equal_windows_pick_equal_places():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 700, dtype=np.uint8)
    a, b = np.concatenate([rng.integers(97, 123, 333, dtype=np.uint8), shared]), np.concatenate([shared, rng.integers(97, 123, 50, dtype=np.uint8)])

    def picks(t):
        got = anchors([t.tobytes()], (400,), 64)
        return {s: (int(q) - s, int(g)) for q, x, y, g in zip(got["p"], got["a0"], got["b0"], got["h"]) for s in range(x, y + 1)}

    pa, pb = picks(a), picks(b)
    assert all(pa[333 + s] == pb[s] for s in range(301)) and sorted(pa) == list(range(len(a) - 399))


def test_sorting():
    rng = random.Random(2)
    strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(300)} | {b"a" * n for n in range(50)})
    assert [strings[i] for i in blind_trie(strings)] == sorted(strings)
    groups = np.array([rng.randrange(3) for _ in strings])
    rank, lcp = deep_shallow(groups, strings)
    order = sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))
    assert [int(rank[i]) for i in order] == list(range(len(strings)))
    for k in range(1, len(order)):
        x, y = strings[order[k - 1]], strings[order[k]]
        want = -1 if groups[order[k - 1]] != groups[order[k]] else next((d for d in range(min(len(x), len(y))) if x[d] != y[d]), min(len(x), len(y)))
        assert lcp[k] == want
