"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of the orders ``order`` to 0 with the counts of
the training bytes. In a context with n occurrences of t different bytes, a byte
seen c times has probability c / (n + t); an unseen one escapes with t / (n + t)
to the next shorter context, and from order 0 to the uniform distribution. In a
context that was never seen nothing is said, and the next shorter one decides. The
statistics are frozen after training, so the code length of (context, byte) is a
constant. A text costs the sum of its bytes' code lengths in each language; the
language with the shortest code wins, and the score is its posterior under equal
priors.

The trees of all languages are compiled into one hash table per order. It maps a
gram (a context and the byte after it) that some language has seen to its exact
code lengths in all languages, escapes to any depth included, so most bytes need
one look-up. For the others the table of contexts has the escapes, and the next
shorter gram is looked up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Table, bounded_batches, encoded, rows_in_blocks, rows_where, staged

UNDETERMINED = "und"
#: What the code of an accepted text may take beyond its language's own texts: bits whatever its length, and bits a byte.
SLACK, MORE = 64, 6.0


def fold_of(column, folds: int = 5):
    """crc32 of an id's decimal text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams of order + 1 bytes that end at each byte of the texts, where each text's begin); before a text stand line breaks."""
    pad = b"\n" * order
    b = np.frombuffer(pad + pad.join(texts), np.uint8).astype(U64)
    n = max(len(b) - order, 0)
    out = np.zeros(n, U64)
    for k in range(order + 1):
        out = (out << U64(8)) | b[k : k + n]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes + order)[:-1]]).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    some = sizes > 0
    inside[begin[some]] += 1
    np.add.at(inside, (begin + sizes)[some], -1)
    return out[np.cumsum(inside[:-1], dtype=np.int8) > 0], np.concatenate([[0], np.cumsum(sizes)])


def _table(grams: np.ndarray) -> Table:
    return Table(grams + U64(1), np.arange(len(grams), dtype=np.int32))


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[Table] = field(default_factory=list)  # by order: grams that any language has seen
    bits: list[np.ndarray] = field(default_factory=list)  # by order: their code lengths, grams x languages
    contexts: list[Table] = field(default_factory=list)  # by order: contexts that any language has seen
    escapes: list[np.ndarray] = field(default_factory=list)  # by order: the escapes' code lengths, contexts x languages
    most: np.ndarray | None = None  # bits a byte of the languages' own texts at most

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits (texts x languages)."""
        grams, at = _grams(texts, self.order)
        each = np.zeros((len(grams), len(self.languages)))
        left = np.arange(len(grams))
        for k in range(self.order, -1, -1):
            if not len(left):
                break
            g = grams[left] & U64((1 << 8 * (k + 1)) - 1)
            i = self.grams[k].get(g + U64(1))
            hit = i >= 0
            each[left[hit]] += self.bits[k][i[hit]]
            left, g = left[~hit], g[~hit]
            c = self.contexts[k].get((g >> U64(8)) + U64(1))
            known = c >= 0
            each[left[known]] += self.escapes[k][c[known]]
        each[left] += 8.0
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(np.diff(at))
        if len(some):
            out[some] = np.add.reduceat(each, at[:-1][some], axis=0)
        return out

    def judged(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether there is a letter, best language's number, its posterior, whether its own texts are coded as shortly) of each text."""
        raw = encoded(texts)
        letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages:
            return letters, np.zeros(len(raw), int), np.zeros(len(raw)), np.ones(len(raw), bool)
        bits = self.code_lengths(raw)
        best = bits.argmin(1)
        least = bits[np.arange(len(raw)), best]
        score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
        fits = least <= (self.most[best] + MORE) * np.fromiter(map(len, raw), float, len(raw)) + SLACK
        return letters, best, score, fits


def _compiled(lang_codes: list[tuple[str, np.ndarray, np.ndarray]], order: int) -> Model:
    """From (language, grams of order + 1 bytes, their counts)."""
    model = Model([x[0] for x in lang_codes], order)
    n_lang = len(lang_codes)
    lower = np.full((1, n_lang), 8.0)
    shorter = np.zeros(1, U64)  # grams of the order below, sorted
    for k in range(order + 1):
        mask = U64((1 << 8 * (k + 1)) - 1)
        own = []
        for _, codes, n in lang_codes:
            g, at = np.unique(codes & mask, return_inverse=True)
            own.append((g, np.bincount(at, weights=n, minlength=len(g))))
        grams = np.unique(np.concatenate([g for g, _ in own]))
        contexts, context_of = np.unique(grams >> U64(8), return_inverse=True)
        counts = np.zeros((len(grams), n_lang))
        for i, (g, n) in enumerate(own):
            counts[np.searchsorted(grams, g), i] = n
        total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        np.add.at(total, context_of, counts)
        np.add.at(kinds, context_of, counts > 0)
        both = np.maximum(total + kinds, 1)
        escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / both), 0.0)
        suffix = np.searchsorted(shorter, grams & (mask >> U64(8))) if k else np.zeros(len(grams), np.int64)
        with np.errstate(divide="ignore"):
            bits = np.where(counts > 0, -np.log2(counts / both[context_of]), escape[context_of] + lower[suffix])
        model.grams.append(_table(grams))
        model.contexts.append(_table(contexts))
        model.bits.append(bits)
        model.escapes.append(escape)
        lower, shorter = bits, grams
    model.most = np.full(n_lang, 8.0)
    return model


def fit(docs: DataFrame, *, max_docs: int = 4000, max_bytes: int = 2 << 20, order: int = 4) -> Model:
    """Learn from (doc_id, text, lang) rows with text and lang.

    At most about ``max_docs`` rows and ``max_bytes`` bytes of a language are read,
    chosen by a hash of their id (the bound of the sample); all others only add to
    the row counts. Rows without id are left out. Without a row to learn from, the
    model has no language: it names none, with score 0.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null and text is not null and lang is not null")
    rows = rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
    if not counts:
        return Model([], order)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    names = sorted(r["lang"] for r in counts)
    rates = {r["lang"]: min(1.0, max_docs / r["n"], max_bytes / max(r["b"], 1)) for r in counts}
    rate = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(rates[k]))])
    number = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])
    sample = staged(rows.where(draw < rate[F.col("lang")]).select(number[F.col("lang")].alias("lang"), "text"), "languages")

    def tally(frames):
        for pdf in frames:
            for lang, part in pdf.groupby("lang"):
                for block in rows_in_blocks(iter([part]), "text"):
                    code, n = np.unique(_grams(encoded(block["text"]), order)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": n})

    got = sample.mapInPandas(tally, "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return Model([], order)
    lang, code, n = (got.column(c).to_numpy() for c in ("lang", "code", "n"))
    model = _compiled([(names[i], code[lang == i].astype(U64), n[lang == i].astype(float)) for i in np.unique(lang).tolist()], order)
    del got, lang, code, n
    shared = docs.sparkSession.sparkContext.broadcast(model)  # no more grams than the bounded sample has

    place = {names.index(k): i for i, k in enumerate(model.languages)}  # a language of empty texts only is not learned

    def weigh(frames):
        m = shared.value
        for pdf in frames:
            pdf = pdf.assign(own=pdf["lang"].map(place))
            for part in rows_in_blocks(iter([pdf[pdf["own"].notna()]]), "text"):
                raw = encoded(part["text"])
                own = part["own"].to_numpy(int)
                bits = m.code_lengths(raw)[np.arange(len(raw)), own]
                rate = np.maximum(bits - SLACK, 0) / np.maximum(list(map(len, raw)), 1)
                yield pd.DataFrame({"i": own, "most": rate}).groupby("i", as_index=False).max()

    for r in sample.mapInPandas(weigh, "i int, most double").groupBy("i").agg(F.max("most").alias("most")).collect():
        model.most[r["i"]] = r["most"]
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; of its columns only doc_id and text are used.

    ``und`` with score 0 for a null text or one without any letter, and if the model
    has no language. Ties go to the first language in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = shared.value
        names = np.array(m.languages or [UNDETERMINED], object)
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text", 1 << 18):
                letters, best, score, _ = m.judged(part["text"])
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "lang_pred": np.where(letters, names[best], UNDETERMINED),
                        "score": np.where(letters, score, 0.0),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a letter and fits a language.

    The language needs a posterior of at least ``least``, and the text a code of no
    more than MORE bits a byte beyond what the language's own texts take at most.
    A model without languages tells letters only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list) -> np.ndarray:
        m = shared.value
        letters, _, score, fits = m.judged(texts)
        return letters & fits & ((score >= least) | (not m.languages))

    return rows_where(docs, keep, "text", 1 << 18)


def op5_language_ppm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold_of("doc_id") != 0))
    return predict(docs, model).select(
        "doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score"
    )
