"""op4 and op7 against the tokenizers library."""

import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from tidemill.llm import token_files as T
from tidemill.llm.bpe_automaton import Automaton, Tokenizer, tokenize

TEXTS = [
    "", " ", "\n\n a  b\t c \n", "don't I'll we've 'tis ''s ab'sd x 's", "<|endoftext|> hello<|startoftext|>x <|endoftext|>",
    "naïve ÉÀ ΣΑΣ İstanbul ß ǅ 日本語 한국어 🎉🎊 é   x　y 1234 ½ ٣٤", "aaaa aaaaaaaaaaaaaaaaaaa", "  \r\n  x", "a͸b",
]


def texts():
    rng = random.Random(7)
    few = "abetinsor' .,!1\n\té<|>"
    many = [chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0x3100), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(200)]
    out = TEXTS + ["".join(rng.choice(few) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    return out + ["".join(rng.choice(many) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["ab" * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_automaton_equals_library(name):
    path = public_tokenizers.path(name)
    lib, own = Library.from_file(path), Tokenizer(path)
    ids, n = own.encode(texts())
    for part, want in zip(np.split(ids, np.cumsum(n)[:-1]), lib.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert part.tolist() == want.ids
        assert own.decode(part) == lib.decode(want.ids, skip_special_tokens=False)


def test_automaton_equals_merging_in_order():
    """Random small merge lists against a plain merge loop, and the accepted pairs against an explicit construction."""
    rng = random.Random(5)
    for _ in range(30):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        while len(merges) < 8:
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        auto = Automaton(vocab, merges)
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(60)]
        ids, n = auto.encode([w.encode() for w in words])
        for w, part in zip(words, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            got = list(w)
            for u, v in merges:
                out, k = [], 0
                while k < len(got):
                    if got[k : k + 2] == [u, v]:
                        out.append(u + v)
                        k += 2
                    else:
                        out.append(got[k])
                        k += 1
                got = out
            assert [auto.labels[i] for i in part] == got


def test_tokenize_digests(spark):
    lib = Library.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[3]])]
    got = tokenize(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), path, with_ids=True).orderBy("doc_id").collect()
    for (_, t, _), r in zip(rows, got, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["ids"], r["decoded"]) == (ids, decoded)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids))), digest(decoded))


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000, T.BLOCK + 3):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        r = T.Reader(T.pack(ids, [None, 5], [n, 0], mode))
        assert (r.ids() == ids).all() and r.head["null"] == [0]
        if n > T.BLOCK:
            assert (r.block(1) == ids[T.BLOCK :]).all()
    with pytest.raises(ValueError, match="torn"):
        T.Reader(T.pack(ids, [1], [3])[:-1])


def test_files_equal_library(spark, tmp_path):
    lib = Library.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(i * 7 % 400, t, "x") for i, t in enumerate([t or None for t in texts()])] + [(3, "again", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, start string")
    T.write_tokens(df, f"file://{tmp_path}/t", path, file_bytes=4000)
    got = T.read_tokens(spark, f"file://{tmp_path}/t", with_ids=True).orderBy("start").collect()
    want = sorted((-1 if i is None else i, tuple(lib.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t, _ in docs)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    T.write_tokens(df.limit(0), f"file://{tmp_path}/empty", path)
    assert T.read_tokens(spark, f"file://{tmp_path}/empty").count() == 0


def test_hot_ids_fill_several_files(spark, tmp_path):
    """A third of all rows has one id, a third none; repeated rows, very long texts; order and starts stay right."""
    lib = Library.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(i, f"text {i} of many") for i in range(100)] + [(40, f"hot {i}") for i in range(100)] + [(None, f"none {i % 7}") for i in range(100)] + [(41, "long words " * 20000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    T.write_tokens(df, f"file://{tmp_path}/t", path, file_bytes=300)
    per_file = {r["file"]: r["docs"] for r in spark.read.parquet(f"file://{tmp_path}/t/manifest").collect()}
    assert len(per_file) > 15 and max(per_file.values()) < 60
    got = T.read_tokens(spark, f"file://{tmp_path}/t", with_ids=True).orderBy("start").collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r["doc_id"]), tuple(r["ids"])) for r in got) == sorted((key(i), (*lib.encode(t, add_special_tokens=False).ids, 0)) for i, t in docs)
    assert [key(r["doc_id"]) for r in got] == sorted(key(r["doc_id"]) for r in got)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_every_code_point_encodes_as_the_library_does():
    """Each of the 1,114,112 code points but surrogates, between letters, digits and signs."""
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        lib, own = Library.from_file(path), Tokenizer(path)
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        for begin in range(0, len(points), 1 << 17):
            some = ["".join(f"a{chr(c)}b 1{chr(c)} !{chr(c)}{chr(c)} " for c in points[i : i + 16]) for i in range(begin, min(begin + (1 << 17), len(points)), 16)]
            ids, n = own.encode(some)
            for k, (part, want) in enumerate(zip(np.split(ids, np.cumsum(n)[:-1]), lib.encode_batch_fast(some, add_special_tokens=False), strict=True)):
                assert part.tolist() == want.ids, (name, hex(points[begin + 16 * k]))


def test_words_go_to_the_model_alone():
    """Texts of known characters are cut once, here; very long words and all code points come out as from the library."""
    lib, enc = Library.from_file(path := public_tokenizers.path("byte_bpe_50k.json")), T.LibraryEncoder(path)
    want = lambda some: [e.ids for e in lib.encode_batch_fast(some, add_special_tokens=False)]
    got = lambda some: [part.tolist() for part in np.split(*(lambda ids, n: (ids, np.cumsum(n)[:-1]))(*enc.encode(some)))]
    odd = texts() + ["ab" * T.LONG + " x", "é" * T.LONG, " \n" * T.LONG + "x"]
    assert got(odd) == want(odd)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 1 << 17):
        some = ["".join(f"a{chr(c)}b 1{chr(c)} '{chr(c)}{chr(c)} \n{chr(c)}s" for c in points[i : i + 16]) for i in range(begin, min(begin + (1 << 17), len(points)), 16)]
        assert got(some) == want(some)
    plain = [t for t in TEXTS if "<|" not in t and "\u0378" not in t]
    alone = T.LibraryEncoder(path)
    alone.lib = SimpleNamespace(model=alone.lib.model)  # no way to encode a text
    ids, n = alone.encode(plain)
    assert len(plain) > 5 and [part.tolist() for part in np.split(ids, np.cumsum(n)[:-1])] == want(plain)


def test_transitions_are_kept_in_a_table():
    """What the table says of a pair is what undoing gadgets says, for pairs asked again too."""
    auto = Tokenizer(public_tokenizers.path("word_bpe_49k.json")).automaton
    rng = np.random.default_rng(2)
    made = np.flatnonzero(auto.born >= 0)
    for _ in range(3):
        t, x = rng.choice(made[:2000], 500), rng.choice(made[:2000], 500)
        assert (auto.allowed(t, x) == auto.has(t, x)).all() and (auto.allowed(x, t) == auto.has(x, t)).all()
