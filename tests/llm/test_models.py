"""op5 and op6: held-out accuracy, edge cases; op2: recall; op9: planted leaks."""

import random
import zlib

import numpy as np
import pytest

from tidemill.llm import cross_polytope, decontaminate, language_ppm, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_ppm.op5_language_ppm(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(rows) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_by_definition(order):
    """Random bytes against the definition, a byte at a time, two languages."""
    rng = random.Random(order)
    pad = b"\n" * order
    draw = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    texts = {"x": [draw(b"ab\n", 60), draw(b"abc\xff", 40), b""], "y": [draw(b"bcd\x00", 80), draw(bytes(range(256)), 300)]}
    counts = {g: {} for g in texts}
    for g, own in texts.items():
        for t in own:
            p = pad + t
            for i in range(len(t)):
                for k in range(order + 1):
                    at = counts[g].setdefault(p[i + order - k : i + order], {})
                    at[p[i + order]] = at.get(p[i + order], 0) + 1

    def probability(g, context, byte):
        at = counts[g].get(context, {})
        total, kinds = sum(at.values()), len(at)
        if byte in at:
            return at[byte] / (total + kinds)
        rest = probability(g, context[1:], byte) if context else 1 / 256
        return (kinds / (total + kinds) if total else 1) * rest

    tally = []
    for g, own in texts.items():
        code, n = np.unique(language_ppm._grams(own, order)[0], return_counts=True)
        tally.append((g, code, n.astype(float)))
    model = language_ppm._compiled(tally, order)
    probes = [b"", b"abab", texts["x"][0], texts["y"][1], draw(bytes(range(256)), 200), b"\n\n", draw(b"abcd", 5000)]
    got = model.code_lengths(probes)
    for i, t in enumerate(probes):
        p = pad + t
        for j, g in enumerate(texts):
            bits = -sum(np.log2(probability(g, p[k : k + order], p[k + order])) for k in range(len(t)))
            assert got[i, j] == pytest.approx(bits, rel=1e-9)


def test_every_byte_is_a_symbol(spark):
    """Languages that differ in rare bytes only."""
    common = "".join(map(chr, range(33, 127))) + "".join(chr(0x3041 + 64 * i) for i in range(24)) + "".join(map(chr, range(0x80, 0xC0)))
    rows = [(i, common * 3 + {"a": "\u0416", "b": "\u05d0"}[g], g) for i, g in enumerate("ab" * 3)]
    model = language_ppm.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = model.code_lengths(["\u0416\u0416".encode(), "\u05d0\u05d0".encode()])
    assert got[0, 0] < got[0, 1] - 4 and got[1, 1] < got[1, 0] - 4


def test_language_acceptance(spark):
    """Letterless texts go with and without a model; so do texts that no learned language is like."""
    rng = random.Random(1)
    train = [(i, " ".join(rng.choice("the cat sat on a mat and saw dogs".split()) for _ in range(60)), "en") for i in range(30)]
    train += [(100 + i, " ".join(rng.choice("der hund und die katze sind hier".split()) for _ in range(60)), "de") for i in range(30)]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(train, schema)
    noise = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400))
    probe = spark.createDataFrame([(1, "the cat and a mat", None), (2, "1 2 3", None), (3, None, None), (4, noise, None), (5, "the cat sat on a mat " * 20000, None)], schema)
    kept = lambda model: sorted(r["doc_id"] for r in language_ppm.accepted(probe, model).collect())
    assert kept(language_ppm.fit(docs)) == [1, 5]
    assert kept(language_ppm.fit(docs.limit(0))) == [1, 4, 5]


def test_language_edges(spark):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat is here and there", "en"), ("der hund und die katze", "de")] * 5)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language_ppm.fit(train)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the cat"), (4, "und der"), (None, "the")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["lang_pred"]) for r in language_ppm.predict(df, model).collect())
    assert got == [(-1, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "en")]
    assert language_ppm.predict(df.limit(0), model).count() == 0
    none = language_ppm.predict(df, language_ppm.fit(train.where("lang = 'xx'"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none if r["doc_id"] != 4} == {("und", 0.0)} == {(r["lang_pred"], r["score"]) for r in none}


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.op6_toxicity(spark, DATA).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    pos, neg = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc >= 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x", 3)], "doc_id long, text string, score int")
    one_class = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, one_class)
    assert [r["predicted"] for r in toxicity.predict(docs, model).collect()] == [0, 0, 0]
    assert toxicity.predict(docs, toxicity.fit(docs.limit(0), one_class.limit(0))).count() == 3


def test_isotonic_is_monotone_and_mean_preserving():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=300), rng.uniform(0.5, 2, 300)
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-x))).astype(float)
    places, values = toxicity.isotonic(x, y, w)
    assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all()


def test_neighbours_recall_and_scores(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    ids, v = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    hits = total = 0
    for r in cross_polytope.op2_cross_polytope(spark, DATA).collect():
        d = np.sqrt(((v - rows[r["query_id"]]) ** 2).sum(1))
        d[ids == r["query_id"]] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + (r["vec_id"] in best), total + 1
        assert r["score"] == pytest.approx(d[np.searchsorted(ids, r["vec_id"])], abs=1e-12)
    assert total == 10 * (ids % 100 == 0).sum() and hits >= 0.9 * total


def test_neighbours_edges(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(100, [0.9, 0.1, 0.0]), (101, [0.0, 0.0, 0.0]), (102, None), (103, [1.0, float("nan"), 0.0]), (None, [1.0, 0.0, 0.0]), (104, [1.0, None, 0.0]), (105, [1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in cross_polytope.neighbours(df, df.where("vec_id in (0, 20, 101)"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, k + 1, k + 1) for k in range(5)] + [(20, k + 1, k) for k in range(5)]
    assert cross_polytope.neighbours(df.limit(0), df).count() == 0


def tiling(item, doc, width):
    """Greedy string tiling by definition."""
    a, b, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < width:
            return covered
        a[i : i + n], b[j : j + n] = [True] * n, [True] * n
        covered += n


def test_tiles_equal_definition():
    rng = random.Random(3)
    for _ in range(60):
        item, doc = [rng.choice("abc") for _ in range(rng.randint(3, 14))], [rng.choice("abc") for _ in range(rng.randint(3, 25))]
        seeds = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if item[i : i + 3] == doc[j : j + 3]]
        got = sum(t[2] for t in decontaminate.tiles(np.array(seeds), 3)) if seeds else 0
        assert got == tiling(item, doc, 3)


def test_found_equals_definition():
    """Items and texts over few words, so that seeds repeat in both; shorter items than a seed too."""
    rng = random.Random(8)
    some = lambda low, high: [rng.choice("abcd") for _ in range(rng.randint(low, high))]
    for least in (0.5, 0.8, 1.0):
        items, docs = [some(1, 12) for _ in range(30)], [some(0, 30) for _ in range(40)]
        items += [items[0], ["a"] * 9]
        block = decontaminate.Block(list(range(len(items))), [" ".join(x) for x in items], 3)
        got = decontaminate._found(block, [" ".join(d) for d in docs], least)
        share = {(d, i): tiling(x, y, min(3, len(x))) / len(x) for i, x in enumerate(items) for d, y in enumerate(docs)}
        assert sorted(got) == sorted((d, i, s) for (d, i), s in share.items() if s >= least)


def test_a_common_line_of_items_and_texts():
    """A line that 3,000 items hold and a text repeats 50,000 times: a seed counts once for a text."""
    line, own = "the usual first line of it", [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(3000)]
    block = decontaminate.Block(list(range(3000)), [f"{line} {x}" for x in own], 5)
    got = decontaminate._found(block, [f"{line} " * 50_000 + own[7], line], 0.7)
    assert [(d, i) for d, i, _ in got] == [(0, 7)]


def test_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    docs = [
        (1, "some text " + item.upper() + " more"), (2, "x " + " ".join(words[20:] + ["q"] + words[:20])), (3, " ".join(words[:30])), (4, " ".join(words[:34])),
        (5, None), (6, ""), (7, "a b c"), (8, "x, a! b - c."), (None, item),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, "a b c"), (12, None), (13, ""), (None, "w1 w2 w3 w4 w5")], "item_id long, text string")
    want = [(-1, 10), (1, 10), (2, 10), (4, 10), (7, 11), (8, 11)]
    for block in (16 << 20, 50):
        got = decontaminate.leaks(df, bench, block_bytes=block).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in got) == want
    rows = decontaminate.judged(df, bench).collect()
    assert len(rows) == len(docs) and {r["doc_id"] for r in rows if r["contaminated"]} == {1, 2, 4, 7, 8}
    assert decontaminate.judged(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_uncontaminated_rows(spark):
    """Rows are judged one by one, whatever their ids, in one block or several."""
    words = [f"w{i}" for i in range(40)]
    item, other = " ".join(words), " ".join(f"v{i}" for i in range(20))
    rows = [(None, item), (None, "x"), (1, item + " q"), (1, "y"), (2, None), (3, " ".join(words[20:] + words[:20])), (4, "a " * 50000 + other)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, other), (10, item), (12, None)], "item_id long, text string")
    for block in (16 << 20, 50):
        got = decontaminate.uncontaminated(df, bench, block_bytes=block)
        assert got.columns == df.columns
        assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect() if r["text"]) == [(-1, "x"), (1, "y")] and got.count() == 3
    assert decontaminate.uncontaminated(df, bench.limit(0)).count() == len(rows)


def test_neighbours_repeated_rows_and_few_vectors(spark):
    """Repeated rows take no places, and where few vectors are met all are compared."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(10, 64))
    rows = [(i, v[i].tolist()) for i in range(10)] * 3 + [(50, v[0].tolist())] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cross_polytope.neighbours(df, df.where("vec_id < 3"), 10).collect()
    for q in range(3):
        d = {i: float(np.sqrt(((v[i % 50] - v[q]) ** 2).sum())) for i in [*range(10), 50] if i != q}
        want = sorted(d, key=lambda i: (d[i], i))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[1] for m in mine] == want and [m[0] for m in mine] == list(range(1, 11))
        assert all(m[2] == pytest.approx(d[m[1]], abs=1e-12) for m in mine)


def test_neighbours_of_a_hot_vector(spark):
    """A third of all rows are equal, another third is in one bucket; groups are split on both sides."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    v = [base] * 400 + [base + 0.01 * rng.normal(size=16) for _ in range(400)] + list(rng.normal(size=(400, 16)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = cross_polytope.neighbours(df, df.where("vec_id % 10 = 0"), 5, part=64).toPandas()
    x, hits = np.stack(v), 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), d))[:5]) & set(own["vec_id"]))
    assert len(got) == 600 and hits >= 0.9 * 600


def test_candidates_become_a_smaller_share():
    """Twice the letters for more vectors: the same recall meets a smaller part of them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 32))
    shares = []
    for n in (1000, 16000):
        v = centres[rng.integers(0, 200, n)] + 0.5 * rng.normal(size=(n, 32))
        index = cross_polytope.Index(32, n, 16)
        codes, asked = index.codes(v), v[:30]
        best = np.argsort(((v[:, None] - asked[None]) ** 2).sum(2), axis=0)[1:11]
        for probes in (20, 50, 100, 200, 400, 800):
            table, code = index.probed(asked, probes)
            met = np.stack([np.any([np.isin(codes[:, t], code[i][table[i] == t]) for t in range(16)], axis=0) for i in range(30)])
            if np.mean([met[i][best[:, i]].mean() for i in range(30)]) >= 0.9:
                break
        shares.append(met.mean())
    assert np.prod(cross_polytope.letters_for(1000, 32)) < np.prod(cross_polytope.letters_for(16000, 32)) and shares[1] < 0.6 * shares[0] and shares[1] < 0.05


def test_boosting_equals_a_direct_search():
    """Each split is the best of all features and edges, each leaf the second-order step, by plain loops."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 4)).round(2)
    y = ((x[:, 0] > 0.2) ^ (rng.uniform(size=120) < 0.2)).astype(float)
    w = rng.uniform(0.5, 2, 120)
    depth, rate, bins = 2, 0.3, 16
    model = toxicity.boost(x, y, w, trees=3, depth=depth, rate=rate, bins=bins)
    prior = (w * y).sum() / w.sum()
    raw, ridge = np.full(120, np.log(prior / (1 - prior))), w.mean()
    edges = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]))) for c in x.T]

    def grow(rows, level):
        """Leaf values of a subtree's rows."""
        if level == depth:
            return {i: -rate * g[rows].sum() / (h[rows].sum() + ridge) for i in rows}
        score = lambda s: g[s].sum() ** 2 / (h[s].sum() + ridge)
        best = (1e-9, None)
        if len(rows) >= 10:
            for f, own in enumerate(edges):
                for e in own:
                    left = [i for i in rows if x[i, f] <= e]
                    right = [i for i in rows if x[i, f] > e]
                    gain = score(left) + score(right) - score(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (left, right))
        left, right = best[1] or (rows, [])
        return grow(left, level + 1) | (grow(right, level + 1) if right else {})

    for _ in range(3):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        step = grow(list(range(120)), 0)
        raw = raw + np.array([step[i] for i in range(120)])
    assert model.raw(x) == pytest.approx(raw, abs=1e-9)


def test_isotonic_is_the_best_monotone_fit():
    """Against the max-min formula of isotonic regression."""
    rng = np.random.default_rng(3)
    raw, y, w = np.sort(rng.normal(size=40)), rng.integers(0, 2, 40).astype(float), rng.uniform(0.5, 2, 40)
    mean = lambda a, b: (w[a : b + 1] * y[a : b + 1]).sum() / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert sorted(set(np.round(want, 9))) == sorted(set(np.round(toxicity.isotonic(raw, y, w)[1], 9)))


def test_lexicon_and_features_by_plain_strings():
    import re

    rng = random.Random(7)
    lexicon = toxicity.Lexicon(["bad", "wor*", "worse", "ugly*"], [1.0, 2.0, 3.0, 0.5])
    vocabulary = "bad Bad badly wor words worse WORSE ugly uglier you Your fine b4d w0rse a".split()
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "!", ",", " -"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "bad " * 40000]
    got = toxicity.features([t.encode() for t in texts], lexicon)
    at = {n: i for i, n in enumerate(toxicity.NAMES)}
    weigh = lambda w: max([v for k, v in {"bad": 1.0, "worse": 3.0}.items() if w == k] + [v for k, v in {"wor": 2.0, "ugly": 0.5}.items() if w.startswith(k)], default=None)
    for t, row in zip(texts, got, strict=True):
        words = [w.lower() for w in re.findall(r"[0-9A-Za-z]+", t)]
        hits = [i for i, w in enumerate(words) if weigh(w) is not None]
        you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
        assert row[at["hits"]] == len(hits)
        assert row[at["strongest"]] == max([weigh(words[i]) for i in hits], default=0)
        assert row[at["weight_density"]] == pytest.approx(sum(weigh(words[i]) for i in hits) / max(len(words), 1))
        assert row[at["near_you"]] == sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hits)
        assert row[at["capitals"]] == pytest.approx(sum("A" <= c <= "Z" for c in t) / max(len(t), 1))
        assert row[at["bangs"]] == pytest.approx(sum(c in "!?" for c in t) / max(len(t), 1))
