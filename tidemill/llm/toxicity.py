"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words (which catch inflected forms),
that stand in toxic texts more often than chance, with their log odds. Features of a text are densities of lexicon words, how often
one stands near a word of the second person, rates of capitals, punctuation and
obfuscation (signs or digits within words, stretched letters, lexicon words that
only show once look-alike characters are undone), and lengths. Trees are grown on
histograms with second-order logistic gradients; an isotonic fit on rows that the
trees have not seen turns their sums into probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, bounded_batches, encoded, folded, rows_in_blocks, separators, span_hashes, staged
from .decontaminate import WORD_BREAKS, WORD_TABLE
from .language_ppm import fold_of

TABLE = folded(WORD_TABLE)
# Words of the second person in the four languages of the corpus.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi te ton ta vous votre tú ti usted vosotros".split()
# Characters often put for letters.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
NEAR = 5
BEGINNINGS = (4, 5, 6)

LETTERS = separators((65, 90), (97, 122), (128, 255))
CAPITALS = separators((65, 90))
BANGS = separators((33, 33), (63, 63))
SIGNS = separators((33, 47), (58, 64), (91, 96), (123, 126))
UNDO = np.arange(256, dtype=np.uint8)
for _a, _b in LOOK_ALIKES.items():
    UNDO[ord(_a)] = ord(_b)


def word_keys(words: list[str]) -> np.ndarray:
    w = Words([x.encode() for x in words], WORD_BREAKS, TABLE)
    return w.hashes[w.first[:-1]] if len(w.hashes) else np.empty(0, U64)


class Lexicon:
    """Whole words, and beginnings of words (written with a final asterisk), with weights."""

    def __init__(self, words: list[str], weights: list[float]):
        self.you = np.sort(word_keys(SECOND_PERSON))
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []  # bytes of a beginning (0: whole words), keys, weights
        weights = np.array(weights, float)
        sizes = np.array([len(w[:-1].encode()) if w.endswith("*") else 0 for w in words], int)
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            keys = word_keys([words[i].rstrip("*") for i in at])
            order = np.argsort(keys)
            self.parts.append((n, keys[order], weights[at][order]))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are in the lexicon, and the largest weight of what matches (0 for others)."""
        hit, weight = np.zeros(len(words.hashes), bool), np.zeros(len(words.hashes))
        for n, keys, weights in self.parts:
            rows = np.flatnonzero(words.ends - words.starts >= n) if n else slice(None)
            h = span_hashes(TABLE[words.buf], words.starts[rows], words.starts[rows] + n) if n else words.hashes
            if len(h):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ok = keys[at] == h
                hit[rows] |= ok
                weight[rows] = np.maximum(weight[rows], np.where(ok, weights[at], 0.0))
        return hit, weight


NAMES = (
    "weight_density hits hit_density strongest near_you near_you_density capitals capital_words bangs signs inner_signs "
    "stretched undone undone_density log_words word_length"
).split()


def features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """Texts x NAMES."""
    w = Words(texts, WORD_BREAKS, TABLE)
    buf, at = w.buf, w.at
    n_words = np.diff(w.first).astype(float)
    per_word, size = np.maximum(n_words, 1), np.maximum(np.diff(at) - 1, 1).astype(float)

    def by_text(values, first=w.first):
        s = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
        return s[first[1:]] - s[first[:-1]]

    def by_byte(mask):
        return by_text(mask, at) / size

    hit, weight = lexicon.find(w)
    hits = by_text(hit)
    strongest = np.zeros(len(texts))
    place = np.flatnonzero(hit)
    text_of = np.searchsorted(w.first, place, "right") - 1
    np.maximum.at(strongest, text_of, weight[place])
    you = np.flatnonzero(np.isin(w.hashes, lexicon.you))
    near = np.zeros(len(texts))
    if len(you) and len(place):
        k = np.searchsorted(you, place)
        before, after = you[np.maximum(k - 1, 0)], you[np.minimum(k, len(you) - 1)]
        text_end, text_start = w.first[text_of + 1], w.first[text_of]
        ok = ((np.abs(place - before) <= NEAR) & (before >= text_start)) | ((np.abs(after - place) <= NEAR) & (after < text_end) & (after >= text_start))
        np.add.at(near, text_of, ok)
    capital = CAPITALS[buf]
    cap_sum = np.concatenate([[0], np.cumsum(capital)])
    length = w.ends - w.starts
    all_caps = (cap_sum[w.ends] - cap_sum[w.starts] == length) & (length > 1)
    letter, sign = LETTERS[buf], SIGNS[buf]
    inner = np.zeros(len(buf), bool)
    inner[1:-1] = letter[:-2] & letter[2:] & (sign | ((buf >= 48) & (buf <= 57)))[1:-1]
    stretched = np.zeros(len(buf), bool)
    stretched[2:] = letter[2:] & (buf[2:] == buf[1:-1]) & (buf[2:] == buf[:-2])
    undone = Words([UNDO[np.frombuffer(t, np.uint8)].tobytes() for t in texts], WORD_BREAKS, TABLE)
    more = np.maximum(by_text(lexicon.find(undone)[0], undone.first) - hits, 0)
    return np.stack(
        [
            by_text(weight) / per_word, hits, hits / per_word, strongest, near, near / per_word, by_byte(capital),
            by_text(all_caps) / per_word, by_byte(BANGS[buf]), by_byte(sign), by_byte(inner), by_byte(stretched),
            more, more / per_word, np.log1p(n_words), by_text(length) / per_word,
        ],
        axis=1,
    )


@dataclass
class Boosted:
    """Trees of fixed depth as arrays: a feature and a threshold for each inner node, a value for each leaf."""

    depth: int = 3
    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            out += leaf[node - (1 << self.depth) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48) -> Boosted:
    prior = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    model = Boosted(depth, float(np.log(prior / (1 - prior))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    raw = np.full(len(x), model.start)
    ridge = 1.0 * weight.mean()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                rows = np.flatnonzero(node == k)
                gain, cut = 1e-9, None
                if len(rows) >= 10:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    whole = total_g**2 / (total_h + ridge)
                    for f, e in enumerate(edges):
                        if len(e):
                            sg = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                            sh = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                            gains = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - whole
                            i = int(gains.argmax())
                            if gains[i] > gain:
                                gain, cut = gains[i], (f, e[i])
                if cut:
                    feature[k], threshold[k] = cut
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
        spot = node - (1 << depth) + 1
        leaf = -rate * np.bincount(spot, g, 1 << depth) / (np.bincount(spot, h, 1 << depth) + ridge)
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.leaf.append(leaf)
        raw += leaf[spot]
    return model


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: places and values of a non-decreasing fit, interpolated between."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # value, weight, raw sum
    for r, v, w in zip(raw[order], y[order], weight[order], strict=True):
        blocks.append([float(v), float(w), float(r * w)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, r2 = blocks.pop()
            v1, w1, r1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, r1 + r2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    places: np.ndarray
    values: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        raw = self.trees.raw(features(texts, self.lexicon))
        fitted = np.interp(raw, self.places, self.values)
        # a thousandth of the trees' own probability keeps the order within a step of the fit
        return 0.999 * fitted + 0.001 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12000, words: int = 400) -> Model:
    """Learn from documents (doc_id, text) with a label (doc_id, toxic).

    At most about ``max_rows`` / 2 rows of each class are used, chosen by a hash of
    their id (the bound of the sample) and weighted by the class' real share; the
    lexicon holds at most ``words`` words. Repeated labels of an id count as toxic if
    one is. Without labelled rows, or with rows of one class only, every score is
    that class' share (0 without rows).
    """
    bounded_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = docs.select("doc_id").distinct().join(marks, "doc_id")
    sizes = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sum(n for t, n in sizes.items() if t != 1)
    if not pos or not neg:
        share = 1.0 if pos else 0.0
        return Model(Lexicon([], []), Boosted(), np.array([0.0]), np.array([share]))
    rates = [min(1.0, max_rows / 2 / n) for n in (neg, pos)]
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    is_toxic = F.col("toxic") == 1
    # some max_rows ids, whatever the input, so they go to the texts and not the texts to them
    chosen_ids = staged(ids.where(draw < F.when(is_toxic, rates[1]).otherwise(rates[0])), "chosen")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen_ids), "doc_id").select("doc_id", "text", is_toxic.cast("int").alias("toxic"))
    sample = staged(sample, "sample")
    # a word's log odds: how often it occurs in toxic and in other texts (at most thrice in one)

    def tally(frames):
        for pdf in frames:
            counts = [Counter(), Counter(), Counter()]  # in other texts, in toxic ones, toxic texts with it
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
                own = Counter(words)
                for n in BEGINNINGS:
                    own.update(w[:n] + "*" for w in words if len(w) >= n)
                counts[toxic].update({w: min(c, 3) for w, c in own.items()})
                if toxic:
                    counts[2].update(own.keys())
            keys = list(counts[0] | counts[1])
            q, p, d = ([c[w] for w in keys] for c in counts)
            yield pd.DataFrame({"word": keys, "p": p, "q": q, "d": d})

    seen = sample.mapInPandas(tally, "word string, p long, q long, d long").groupBy("word").agg(*[F.sum(c).alias(c) for c in "pqd"])
    ratio = F.lit(float(np.log((pos * rates[1] + 1) / (neg * rates[0] + 1))))
    odds = F.log(F.col("p") + 0.5) - F.log(F.col("q") + 0.5) - ratio
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    top = (
        seen.where("d >= 4")
        .select("word", odds.alias("odds"), (odds / error).alias("z"))
        .where("z > 4 and odds > 1.2")
        .orderBy(F.desc("z"), "word")
        .limit(words)
        .collect()
    )
    lexicon = Lexicon([r["word"] for r in top], [r["odds"] for r in top])

    def measure(frames):
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text", 1 << 20):
                x = features(encoded(part["text"]), lexicon)
                yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "x": list(x)})

    rows = sample.mapInPandas(measure, "doc_id long, toxic int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x, y = np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy(float)
    weight = np.where(y == 1, 1 / rates[1], 1 / rates[0])
    apart = (rows["doc_id"].to_numpy(np.int64) * 2654435761 % (1 << 32)) >> 30 == 0  # a quarter calibrates
    if not (0 < y[apart].sum() < apart.sum() and 0 < y[~apart].sum() < (~apart).sum()):
        apart = np.zeros(len(y), bool)
    trees = boost(x[~apart], y[~apart], weight[~apart])
    on = apart if apart.any() else ~apart
    places, values = isotonic(trees.raw(x[on]), y[on], weight[on])
    return Model(lexicon, trees, places, values)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row; only doc_id and text are used, a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text", 1 << 20):
                s = np.clip(shared.value.score(encoded(part["text"])), 0, 1)
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where(fold_of("doc_id") != 0), labels)
    return predict(docs, model).select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", "predicted")
