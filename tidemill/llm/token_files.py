"""Token files: ids in bit or byte planes, compressed plane by plane.

A file holds the ids of a run of documents in ascending doc_id order:

    magic | blocks | index (zstd-compressed JSON and arrays) | place of the index, uint64 | magic

A block is ``block`` ids (the last one fewer). Its ids, as little-endian uint32,
are transposed: byte plane k has byte k of every id, bit plane k bit k of every
id. High planes are nearly constant and almost vanish under zstandard. The index
has the place and the plane sizes of every block, so any block is read without
the others, and for every document its id and its count of token ids.

Files are named by the number of their run; runs are ranges of doc_id, so file
order is document order. A manifest table lists the files of an archive.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_automaton import byte_alphabet
from .common import bounded_batches, rows_in_blocks, shared_dir
from .tokens import Batch, Memo, ragged

MAGIC = b"TIDETOK1"
BLOCK = 1 << 16
#: Bytes of a word from which on the library's leaner whole encoding is used.
LONG = 4096


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def pack(ids: np.ndarray, doc_ids: list, counts: np.ndarray, mode: str = "byte", block: int = BLOCK, level: int = 1) -> bytes:
    """A whole file. Null doc_ids are kept."""
    z = zstandard.ZstdCompressor(level=level)
    out, at, index = [MAGIC], len(MAGIC), []
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        planes = [z.compress(p) for p in to_planes(part, mode)]
        index.append([at, len(part), *map(len, planes)])
        out += planes
        at += sum(map(len, planes))
    null = [k for k, d in enumerate(doc_ids) if d is None or d != d]
    docs = np.array([0 if d is None or d != d else d for d in doc_ids], "<i8")
    head = json.dumps({"mode": mode, "ids": len(ids), "docs": len(docs), "blocks": index, "null": null}).encode()
    body = struct.pack("<I", len(head)) + head + docs.tobytes() + np.asarray(counts, "<u4").tobytes()
    out += [z.compress(body), struct.pack("<Q", at), MAGIC]
    return b"".join(out)


class Reader:
    """Random access to a file's documents and blocks."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a token file, or a torn one")
        self.data = data
        at = struct.unpack("<Q", data[-16:-8])[0]
        body = zstandard.ZstdDecompressor().decompress(data[at:-16])
        n = struct.unpack("<I", body[:4])[0]
        self.head = json.loads(body[4 : 4 + n])
        k = self.head["docs"]
        self.doc_ids = np.frombuffer(body, "<i8", k, 4 + n)
        self.counts = np.frombuffer(body, "<u4", k, 4 + n + 8 * k)

    def block(self, i: int) -> np.ndarray:
        at, n, *sizes = self.head["blocks"][i]
        z, planes = zstandard.ZstdDecompressor(), []
        for s in sizes:
            planes.append(z.decompress(self.data[at : at + s]))
            at += s
        return from_planes(planes, n, self.head["mode"])

    def ids(self) -> np.ndarray:
        parts = [self.block(i) for i in range(len(self.head["blocks"]))]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


class LibraryEncoder:
    """The tokenizers library behind a memo of words.

    Text is cut into the pattern's words here, vectorised, and only words that the
    memo has not yet are given to the library: to its model, which merges them, in
    the letters that stand for their bytes, for there is nothing left to cut. Texts
    with special tokens, and with characters that this Python's Unicode data does
    not know, go to the library whole; so do very long words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.loads(self.lib.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.known = (
            spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
            and spec["model"]["type"] == "BPE"
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.memo = Memo(self._words, kind=np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32)
        self.letters = np.array([*map(ord, byte_alphabet())], "<u4")
        self.letters[0xFF] = ord("\n")  # no byte's letter

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"\xff".join([w.encode() for w in words]), np.uint8)  # a byte of no UTF-8 text
        spelt = self.letters[raw].tobytes().decode("utf-32-le").split("\n")
        merge = self.lib.model.tokenize
        ids = [[t.id for t in merge(s)] if len(s) < LONG else self._whole([w])[0] for w, s in zip(words, spelt, strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.known and not any(s in t for s in self.special)]
        if plain:
            batch = Batch([texts[i] for i in plain])
            strange = set(batch.unknown_texts().tolist())
            if strange:
                plain = [i for k, i in enumerate(plain) if k not in strange]
                batch = Batch([texts[i] for i in plain]) if plain else None
            if batch is not None:
                m = self.memo
                starts, ends = batch.space_prefixed()
                entry = m.find(batch, starts, ends)
                ids = ragged(m.flat, m.begin[entry], m.size[entry])
                cut = np.concatenate([[0], np.cumsum(m.size[entry])])[np.searchsorted(starts, batch.at)]
                if len(plain) == len(texts):
                    return ids, np.diff(cut)
                for k, i in enumerate(plain):
                    out[i] = ids[cut[k] : cut[k + 1]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = np.array(ids, np.uint32)
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), sizes


_encoders: dict[str, LibraryEncoder] = {}


def _put(path: str, name: str, data: bytes) -> None:
    """Write under another name, then rename: a repeated or lost task leaves no torn file."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{base}/{name}")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, mode: str = "byte", file_bytes: int = 24 << 20) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) into token files below ``path``.

    Each document's ids end with ``end_id``; a null or empty text has only that.
    Documents stand in ascending doc_id order, null ids first. Texts are encoded
    where they are read; what is shuffled into runs of documents is their ids. A run
    is one file and one task, so no task grows with the input; rows of one id, or
    without, that are more than a file has room for are dealt to several runs by a
    number of their own. An empty table makes an empty archive.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size, nameless = F.octet_length("text"), F.col("doc_id").isNull()
    total, without = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(nameless, size)), F.lit(0))).first()
    runs, before = max(1, -(-int(total - without) // file_bytes)), -(-int(without) // file_bytes)
    quantiles = [i / runs for i in range(1, runs)]
    found = docs.agg(F.percentile_approx("doc_id", quantiles, 10 * runs).alias("q")).first()["q"] if quantiles else None
    bounds = np.array(sorted(found or []), np.int64)

    def run_of(ids: pd.Series, numbers: np.ndarray) -> np.ndarray:
        known, own = ids.notna().to_numpy(), ids.fillna(0).to_numpy(np.int64)
        lo, hi = np.searchsorted(bounds, own, "left"), np.searchsorted(bounds, own, "right")
        spans = np.maximum(hi - lo, 1)  # an id that is several bounds fills the runs between them
        run = np.where(hi - lo > 1, lo + 1 + numbers % spans, hi)
        return np.where(known, before + run, numbers % max(before, 1))

    def encode(frames):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = LibraryEncoder(tokenizer)
        enc = _encoders[tokenizer]
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text", 1 << 20):
                ids, n = enc.encode([t if t is not None else "" for t in part["text"]])
                ids = ids.astype(np.uint16 if int(ids.max(initial=0)) < 1 << 16 else np.uint32)
                at = np.concatenate([[0], np.cumsum(n)]).tolist()
                run = run_of(part["doc_id"], part["number"].to_numpy())
                yield pd.DataFrame(
                    {"run": run.astype(np.int32), "doc_id": part["doc_id"], "wide": ids.itemsize, "ids": [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]}
                )

    def flush(run, rows):
        ids = [np.append(np.frombuffer(r[2], np.uint16 if r[1] == 2 else np.uint32).astype(np.uint32), np.uint32(end_id)) for r in rows]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        _put(f"{path}/files", name := f"{run:012d}.tok", pack(np.concatenate(ids), [r[0] for r in rows], counts, mode))
        return pd.DataFrame({"run": [run], "file": [name], "docs": [len(rows)], "n": [int(counts.sum())]})

    def write(frames):
        current, rows = None, []
        for pdf in frames:
            ids = [None if d is None or d != d else int(d) for d in pdf["doc_id"]]
            for run, *row in zip(pdf["run"].tolist(), ids, pdf["wide"].tolist(), pdf["ids"], strict=True):
                if run != current and rows:
                    yield flush(current, rows)
                    rows = []
                current = run
                rows.append(row)
        if rows:
            yield flush(current, rows)

    numbered = docs.withColumn("number", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 62) - 1)))
    coded = numbered.mapInPandas(encode, "run int, doc_id long, wide int, ids binary")
    dealt = coded.repartitionById(before + runs, "run")
    dealt.sortWithinPartitions("run", F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).mapInPandas(
        write, "run long, file string, docs long, n long"
    ).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files below ``path``; start counts all ids before the document."""

    def read(frames):
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                r = Reader(data)
                ids, n = r.ids(), r.counts.astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
                docs = pd.Series(r.doc_ids, dtype="Int64")
                docs[r.head["null"]] = pd.NA
                out = {
                    "file": name.rpartition("/")[2],
                    "doc_id": docs,
                    "local": at[:-1],
                    "n_tokens": n,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
                }
                if with_ids:
                    out["ids"] = np.split(ids.astype(np.int64), at[1:-1])
                yield pd.DataFrame(out)

    bounded_batches(spark)
    manifest = spark.read.parquet(f"{path}/manifest")
    # one row per file: its place among the files
    starts = manifest.select("file", (F.sum("n").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    schema = "file string, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    files = spark.read.format("binaryFile").load(f"{path}/files").select("path", "content")
    return (
        files.mapInPandas(read, schema)
        .join(starts, "file")
        .select("doc_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
    )


def op4_bit_planes(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
