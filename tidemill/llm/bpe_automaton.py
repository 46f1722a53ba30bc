"""Byte-pair encoding by a deterministic automaton over tokens.

Construction. The automaton starts with one state and a loop for every base
symbol, and accepts every sequence of base symbols. The merges are then applied
in order. Merge i, (u, v) -> uv, is a gadget: where a state had u and, after it,
v, it gets the transition uv to the state behind v, and the state behind u is
copied without v. After all gadgets exactly one path spells a given word, and its
arc labels are the word's tokens.

All u transitions of the automaton end in one state at any time (true at the
start, kept by every gadget), so there is a state for each token, and a gadget
changes all states in the same way. The compiled form therefore keeps a table of
gadgets beside the transitions: for a token the time of its gadget and its parts,
and for a pair the time at which its transition was removed. The table of
transitions, (token, token) to open or not, is filled as pairs are met, for of the
tokens squared few ever are. A new entry is read off by going back in time: the
younger of the two gadgets is undone (uv is there if u was; the state behind uv
is the one behind v), until a removal is met or both are base symbols.

Encoding. A word is read from left to right; every place gets the last token of
the path that ends there, the one suffix of the prefix that is a token and that
the state before it has a transition for. The path is read off backwards. All
new words of a batch advance together, one table look-up for all of them.

Decoding emits the arc labels.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONE, U64, Table, bounded_batches, mix64, powers, rows_in_blocks, trim
from .tokens import LETTER, NUMBER, OTHER, SPACE, UNKNOWN, Batch, Memo, classes, ragged

LONG = 12


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Automaton:
    """Compiled from merges. symbols: token strings by id; suffix: the mark of a word's last base symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        size = max(vocab.values()) + 1
        self.labels: list[str] = [""] * size
        for k, i in vocab.items():
            self.labels[i] = k
        self.suffix = suffix
        self.born = np.full(size, -1, np.int32)  # gadget that made the token; -1: base symbol
        self.left, self.right = np.full(size, NONE), np.full(size, NONE)
        gone, when = [], []
        for i, (u, v) in enumerate(merges):
            a, b, t = vocab[u], vocab[v], vocab.get(u + v)
            if t is None:
                continue
            gone.append((a + 1) << 32 | (b + 1))
            when.append(i)
            if self.born[t] < 0:
                self.born[t], self.left[t], self.right[t] = i, a, b
        pairs, first = np.unique(np.array(gone, U64), return_index=True)
        self.removed = Table(pairs, np.array(when, np.int32)[first])
        # a gadget that finds no v behind u adds nothing, nor do gadgets that build on its token
        made = np.flatnonzero(self.born >= 0)
        real = np.ones(size, bool)
        real[made] = self.has(self.left[made], self.right[made], self.born[made])
        for t in made[np.argsort(self.born[made])].tolist():
            real[t] &= real[self.left[t]] & real[self.right[t]]
        base = byte_alphabet()
        self.base = np.full((2, 256), NONE)
        for b, ch in enumerate(base):
            self.base[0, b] = vocab.get(ch, NONE)
            self.base[1, b] = vocab.get(ch + suffix, NONE)
        self.pairs, self.open, self.most_pairs = np.empty(0, U64), np.empty(0, bool), 4_000_000
        # tokens by their bytes; inner tokens and tokens that end a word are told apart
        self.code = mix64(np.arange(1, 257, dtype=U64)) | U64(1)
        value = {ch: b for b, ch in enumerate(base)}
        ids, bodies, ends = [], [], []
        for s, i in vocab.items():
            last = bool(suffix) and s.endswith(suffix)
            body = s[: -len(suffix)] if last else s
            if real[i] and body and all(c in value for c in body) and (self.born[i] >= 0 or len(body) == 1):
                ids.append(i)
                bodies.append(bytes([value[c] for c in body]))
                ends.append(last)
        size = np.fromiter(map(len, bodies), np.int64, len(bodies))
        buf = np.frombuffer(b"".join(bodies), np.uint8)
        sums, at = self._sums(buf), np.cumsum(size)
        keys = self._finish((sums[at] - sums[at - size]) * powers(len(buf) + 1)[1][at - size], np.array(ends, bool))
        self.tokens = Table(keys, np.array(ids, np.int32))
        # lengths of tokens, and the last LONG bytes of the longer ones
        self.lengths = np.unique(size)
        far = np.flatnonzero(size > LONG)
        tail = (sums[at[far]] - sums[at[far] - LONG]) * powers(len(buf) + 1)[1][at[far] - LONG]
        self.tails = np.unique(tail)

    def _sums(self, buf: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf) + 1, U64)
        np.cumsum(self.code[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
        return out

    @staticmethod
    def _finish(h: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix64(h + last.astype(U64)) | U64(1)

    def has(self, t: np.ndarray, x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the state behind token t has a transition for token x (arrays), after all gadgets or before one."""
        t, x = t.copy(), x.copy()
        out = np.ones(len(t), bool)
        limit = np.full(len(t), 1 << 30, np.int32) if before is None else before.astype(np.int32)
        live = np.arange(len(t))
        while len(live):
            a, b = t[live], x[live]
            j = self.removed.get((a.astype(U64) + U64(1)) << U64(32) | (b.astype(U64) + U64(1)))
            lost = (j >= 0) & (j < limit[live])
            out[live[lost]] = False
            live, a, b = live[~lost], a[~lost], b[~lost]
            ba, bb = self.born[a], self.born[b]
            live, a, b, ba, bb = (v[(ba >= 0) | (bb >= 0)] for v in (live, a, b, ba, bb))
            back = ba > bb  # the state's own gadget is the younger
            t[live[back]], limit[live[back]] = self.right[a[back]], ba[back]
            x[live[~back]], limit[live[~back]] = self.left[b[~back]], bb[~back] + 1
        return out

    def allowed(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether the state behind token t has a transition for token x, from the table of transitions.

        The table has the pairs that were met so far; a new pair is worked out once.
        """
        if len(self.pairs) > self.most_pairs:
            self.pairs, self.open = np.empty(0, U64), np.empty(0, bool)
        pair, where = np.unique((t.astype(U64) << U64(32)) | x.astype(U64), return_inverse=True)
        at = np.searchsorted(self.pairs, pair)
        known = np.zeros(len(pair), bool)
        if len(self.pairs):
            known = self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair
        out = np.zeros(len(pair), bool)
        out[known] = self.open[at[known]]
        miss = np.flatnonzero(~known)
        if len(miss):
            out[miss] = self.has((pair[miss] >> U64(32)).astype(np.int32), (pair[miss] & U64(0xFFFFFFFF)).astype(np.int32))
            self.pairs, self.open = np.insert(self.pairs, at[miss], pair[miss]), np.insert(self.open, at[miss], out[miss])
        return out[where]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words, how many each has)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        sizes = size[order]
        buf = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes)])
        # tokens that end at each place, whatever stands before them
        sums, back = self._sums(buf), powers(len(buf) + 1)[1]
        column = np.arange(len(buf)) - np.repeat(at[:-1], sizes)
        final = (column == np.repeat(sizes, sizes) - 1) & bool(self.suffix)
        places, lengths, cands = [], [], []
        place = np.arange(len(buf))
        for n in self.lengths.tolist():
            place = place[column[place] >= n - 1]
            if n > LONG and len(place):
                if n == self.lengths[self.lengths > LONG][0]:
                    tail = (sums[place + 1] - sums[place + 1 - LONG]) * back[place + 1 - LONG]
                    k = np.minimum(np.searchsorted(self.tails, tail), len(self.tails) - 1)
                    place = place[self.tails[k] == tail]
            if not len(place):
                break
            t = self.tokens.get(self._finish((sums[place + 1] - sums[place + 1 - n]) * back[place + 1 - n], final[place]))
            ok = t >= 0
            places.append(place[ok])
            cands.append(t[ok])
            lengths.append(np.full(int(ok.sum()), n, np.int32))
        token, span = np.full(len(buf), NONE), np.zeros(len(buf), np.int32)
        if places:
            places, lengths, cands = np.concatenate(places), np.concatenate(lengths), np.concatenate(cands)
            by = np.argsort(column[places], kind="stable")
            places, lengths, cands = places[by], lengths[by], cands[by]
            for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(column[places])) + 1):
                e, n, t = places[part], lengths[part], cands[part]
                ok = n == column[e] + 1  # the first token of a word follows nothing
                k = np.flatnonzero(~ok)
                before = token[e[k] - n[k]]
                k, before = k[before >= 0], before[before >= 0]
                ok[k] = self.allowed(before, t[k])
                token[e[ok]], span[e[ok]] = t[ok], n[ok]
        # the paths, from their ends
        found: list[tuple[np.ndarray, np.ndarray]] = []
        who, place = np.flatnonzero(sizes > 0), at[1:][sizes > 0] - 1
        while len(who):
            found.append((who, token[place]))
            place = place - span[place]
            keep = place >= at[who]
            who, place = who[keep], place[keep]
        count = np.zeros(len(words), np.int64)
        for w, _ in found:
            count[w] += 1
        total = np.empty(len(words), np.int64)
        total[order] = count
        begin = np.concatenate([[0], np.cumsum(total)])
        ids = np.empty(begin[-1], np.int32)
        for back, (w, t) in enumerate(found):
            ids[begin[order[w]] + count[w] - 1 - back] = t
        return ids, total


class Tokenizer:
    """The tokenizer of a JSON description with a byte-level BPE model, run by the automaton.

    Understood are the two descriptions that the tests compare with the tokenizers
    library: words with a blank in front kept, or lower-cased words with an
    end-of-word mark. Anything else raises ValueError.
    """

    def __init__(self, path: str):
        self.path, self._library, self._classes = path, None, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm = spec["model"], spec["normalizer"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or bool(norm) != bool(self.suffix) or model["continuing_subword_prefix"] or model["dropout"]:
            raise ValueError(f"not a tokenizer this module can run: {path}")
        self.automaton = Automaton(model["vocab"], merges, self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = dict(enumerate(self.automaton.labels)) | {i: s for s, i in self.special.items()}
        self.memo = Memo(
            lambda words: self.automaton.encode([w.encode("utf-8", "surrogatepass") for w in words]),
            limit=1_000_000,
            kind=np.uint16 if len(self.labels) <= 1 << 16 else np.uint32,
        )

    @property
    def library(self):
        """The tokenizers library's reading of the description, asked about characters that this Python's Unicode data lacks."""
        if self._library is None:
            from tokenizers import Tokenizer as Library

            self._library = Library.from_file(self.path)
        return self._library

    def class_of(self, code: int) -> int:
        """Class of a code point without one here, by the library's Unicode data."""
        if code not in self._classes:
            cut = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
            c = chr(code)
            kind = LETTER if cut("a" + c) == 1 else OTHER if cut("!" + c) == 1 else NUMBER if cut(c) and not c.isspace() else SPACE
            self._classes[code] = kind
        return self._classes[code]

    def normalized(self, text: str) -> str:
        if not self.suffix or text.isascii():
            return text.lower() if self.suffix else text
        import unicodedata

        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if (classes()[cp] == UNKNOWN).any():
            return self.library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Memo entry of every word of texts without special tokens, and each text's first word."""
        batch = Batch([self.normalized(t) for t in texts])
        if len(batch.unknown_texts()):
            odd = batch.kind == UNKNOWN
            odd[batch.at[1:] - 1] = False  # the ends of texts
            codes, where = np.unique(batch.cp[odd], return_inverse=True)
            batch.kind[odd] = np.array([self.class_of(int(c)) for c in codes], np.uint8)[where]
        starts, ends = batch.bare() if self.suffix else batch.space_prefixed()
        return self.memo.find(batch, starts, ends), np.searchsorted(starts, batch.at)

    def pieces(self, text: str) -> list[str | int]:
        """A text cut at special tokens, which come as their ids."""
        if not any(s in text for s in self.special):
            return [text]
        import re

        cut = re.split("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")", text)
        return [self.special.get(x, x) for x in cut if x]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        cut = [self.pieces(t) for t in texts]
        plain = [p for c in cut for p in c if isinstance(p, str)]
        entry, first = self.entries(plain)
        m = self.memo
        ids = ragged(m.flat, m.begin[entry], m.size[entry]).astype(np.int64)
        n = np.concatenate([[0], np.cumsum(m.size[entry])])[first]
        if all(len(c) == 1 for c in cut) and len(plain) == len(texts):
            return ids, np.diff(n)
        out, sizes, k = [], [], 0
        for c in cut:
            got = []
            for p in c:
                if isinstance(p, str):
                    got.append(ids[n[k] : n[k + 1]])
                    k += 1
                else:
                    got.append(np.array([p], np.int64))
            out += got
            sizes.append(sum(map(len, got)))
        return (np.concatenate(out) if out else np.empty(0, np.int64)), np.array(sizes, np.int64)

    def decode(self, ids) -> str:
        """Arc labels joined by a blank, as of a description without decoder; else their bytes as UTF-8."""
        labels = [self.labels[int(i)] for i in ids]
        if self.suffix:
            return " ".join(labels)
        value = {ch: b for b, ch in enumerate(byte_alphabet())}
        return bytes(value[c] for s in labels for c in s).decode("utf-8", "replace")


class Emitter:
    """Byte strings by token id, joined by one blank, for whole batches of ids."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(s + b" " for s in strings), np.uint8)
        self.size = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
        self.begin = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, counts: np.ndarray):
        """For each text the bytes of its ids' strings, joined by blanks."""
        size = self.size[ids]
        out = ragged(self.flat, self.begin[ids], size)
        cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        view = memoryview(np.ascontiguousarray(out))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield view[a : max(a, b - 1)]


_loaded: dict[str, tuple] = {}


def _tools(path: str):
    if path not in _loaded:
        t = Tokenizer(path)
        n = max(t.labels) + 1
        _loaded[path] = (
            t,
            Emitter([b"%d" % i for i in range(n)]),
            Emitter([t.labels.get(i, "").encode("utf-8") for i in range(n)]),
        )
        trim()  # the description's text and lists are of no more use
    return _loaded[path]


def tokenize(docs: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row of ``docs`` (doc_id, text).

    A null text is empty: no tokens, the digests of the empty string. Other columns
    are ignored, repeated rows give repeated results, an empty table an empty one.
    Texts of any length are encoded whole.
    """

    def run(frames):
        tok, decimal, labels = _tools(path)
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text"):
                ids, n = tok.encode([t if t is not None else "" for t in part["text"]])
                if tok.suffix:
                    words = list(labels.texts(ids, n))
                else:
                    words = [tok.decode(x).encode() for x in np.split(ids, np.cumsum(n)[:-1])]
                out = {
                    "doc_id": part["doc_id"],
                    "n_tokens": n,
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in decimal.texts(ids, n)],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in words],
                }
                if with_ids:
                    out["ids"] = np.split(ids.astype(np.int32), np.cumsum(n)[:-1])
                    out["decoded"] = [bytes(x).decode("utf-8") for x in words]
                yield pd.DataFrame(out)

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInPandas(run, schema + ", ids array<int>, decoded string" * with_ids)


def op7_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
