"""Removal of repeated substrings by suffix arrays over sampled places, sorted deep-shallow.

A window is ``length`` bytes of a text. Every window picks one of its places, the
``GRAM`` bytes with the smallest hash (the first of equals): an anchor. Equal
windows pick the same place in themselves, so only windows whose anchors hold the
same gram need comparing, and an anchor whose gram occurs once rules out all its
windows without a look at their bytes.

For the anchors of repeated grams, two suffix arrays are built: of the texts to
the right of the anchors, and of the texts to the left, read backwards. The sort
is deep-shallow: multikey quicksort by 8-byte words down to ``SHALLOW`` bytes, then
a blind trie for each group that still agrees. With the longest common prefixes
of neighbours, two windows that start o bytes before their anchors are equal iff
no prefix below o lies between them in the left array, and none below
``length - o`` in the right one.

Exact copies of a text are one text, all of whose windows are repeated. Anchors of
a gram that occurs more than ``crowd`` times are dealt to several tasks; each
resolves what repeats among its own, and what did not is settled across tasks:
blocks of windows that several tasks tell alike are settled as they are, and
different blocks with the bytes common to their windows by a hash of each window.
So no group has to meet in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, bucketed, byte_table, discard, encoded, mix64, powers, rows_in_blocks, staged, staged_at, trim

GRAM, SHALLOW, PIECE, BLOCK, STEP = 64, 32, 1 << 19, 1 << 17, 16
#: Anchors that a task works on together.
AT_ONCE = 4000
TABLE = byte_table(11)


def _hashes(buf: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` bytes."""
    p, q = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(TABLE[buf] * p[: len(buf)], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * q[: len(buf) - width + 1] + U64(salt))


def _pieces(texts: list[bytes], longest: int):
    """(text, offset, bytes) of the texts, the long ones cut so that no window of up to ``longest`` bytes is lost."""
    for i, t in enumerate(texts):
        for s in range(0, max(len(t), 1), PIECE):
            yield i, s, t if len(t) <= PIECE else t[s : s + PIECE + longest - 1]


def anchors(texts: list[bytes], lengths: tuple[int, ...], gram: int) -> pd.DataFrame:
    """Anchors of a list of texts: (i, p, h, a0, b0[, a1, b1]) with the text's number, place, gram hash, and for each length the first and last window.

    Windows are named by their start. ``lengths`` ascend. The smallest hash of a
    window is also that of some shorter window in it, so the anchors of longer
    windows are among those of shorter ones; ones that no long window has get the
    empty range 0, -1.
    """
    low = U64((1 << 24) - 1)
    found: list[list[tuple]] = [[] for _ in lengths]
    block: list[tuple[int, int, bytes]] = []

    def flush():
        buf = np.frombuffer(b"".join(x for _, _, x in block), np.uint8)
        size = np.array([len(x) for _, _, x in block], np.int64)
        at = np.cumsum(size) - size
        owner, offset = np.array([i for i, _, _ in block]), np.array([s for _, s, _ in block], np.int64)
        if len(buf) < lengths[0]:
            return
        h = _hashes(buf, gram)
        keys = (h & ~low) | np.arange(len(h), dtype=U64)
        done = 1
        for k, length in enumerate(lengths):
            width = length - gram + 1
            while done * 2 <= width:
                if len(keys) <= done:
                    return
                keys = np.minimum(keys[:-done], keys[done:])
                done *= 2
            best = keys if width == done else np.minimum(keys[: len(keys) - (width - done)], keys[width - done :])
            edge = np.zeros(len(buf) + 1, np.int8)
            n = np.minimum(size - length + 1, PIECE)
            some = n > 0
            edge[at[some]] += 1
            np.add.at(edge, at[some] + n[some], -1)
            start = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
            if not len(start):
                return
            place = (best[start] & low).astype(np.int64)
            new = np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))
            x = np.flatnonzero(new)
            y = np.append(x[1:] - 1, len(start) - 1)
            part = np.searchsorted(at, start[x], "right") - 1
            move = offset[part] - at[part]
            found[k].append((owner[part], place[x] + move, h[place[x]].view(np.int64), start[x] + move, start[y] + move))

    held = 0
    for i, s, x in _pieces(texts, lengths[-1]):
        if held and held + len(x) > BLOCK:
            flush()
            block, held = [], 0
        block.append((i, s, x))
        held += len(x)
    if block:
        flush()
    out = {}
    for k, parts in enumerate(found):
        i, p, h, a, b = (np.concatenate(v) if parts else np.empty(0, np.int64) for v in (zip(*parts, strict=True) if parts else [()] * 5))
        key = i * np.int64(1 << 40) + p
        # a place whose windows two pieces share
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        i, p, h, key = i[first], p[first], h[first], key[first]
        a, b = (np.minimum.reduceat(a, first), np.maximum.reduceat(b, first)) if len(first) else (a, b)
        if k == 0:
            out = {"i": i, "p": p, "h": h, "a0": a, "b0": b}
            base = key
        else:
            where = np.searchsorted(base, key)
            out[f"a{k}"], out[f"b{k}"] = np.zeros(len(base), np.int64), np.full(len(base), -1, np.int64)
            out[f"a{k}"][where], out[f"b{k}"][where] = a, b
    return pd.DataFrame(out)


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of distinct strings by a blind trie.

    Inner nodes keep only the depth at which their strings first differ; a string
    goes down blindly to some leaf, one comparison with it gives the depth at
    which the string leaves the tree, and there it is put in.
    """

    def char(i, d):
        return strings[i][d] if d < len(strings[i]) else -1

    root = 0  # a leaf is a string's number, an inner node a list [depth, {byte: node}]
    for i in range(1, len(strings)):
        node = root
        while isinstance(node, list):
            c = char(i, node[0])
            node = node[1].get(c) if c in node[1] else next(iter(node[1].values()))
        a, b = strings[i], strings[node]
        d, step = 0, 64
        while a[d : d + step] == b[d : d + step] and d < min(len(a), len(b)):
            d += step
        while d < min(len(a), len(b)) and a[d] == b[d]:
            d += 1
        above, key, node = None, None, root
        while isinstance(node, list) and node[0] < d:
            above, key = node, char(i, node[0])
            node = node[1][key]
        if isinstance(node, list) and node[0] == d:
            node[1][char(i, d)] = i
            continue
        leaf = node
        while isinstance(leaf, list):
            leaf = next(iter(leaf[1].values()))
        fresh = [d, {char(leaf, d): node, char(i, d): i}]
        if above is None:
            root = fresh
        else:
            above[1][key] = fresh
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def deep_shallow(groups: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sort by (group, string): (rank of every string, equal ones sharing it; per rank the common prefix with the one before).

    The common prefix is -1 for the first rank of a group.
    """
    seen: dict[tuple[int, bytes], int] = {}
    same = np.array([seen.setdefault(k, len(seen)) for k in zip(groups.tolist(), strings, strict=True)], np.int64)
    group = np.array([g for g, _ in seen], np.int64)
    own = [s for _, s in seen]
    n = len(own)
    size = np.fromiter(map(len, own), np.int64, n)
    width = -(-max(int(size.max(initial=0)), SHALLOW) // 8) * 8
    matrix = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in own]), np.uint8).reshape(n, width)
    words = matrix[:, :SHALLOW].copy().view(">u8").astype(U64)
    # shallow: multikey quicksort, a word at a time, among those that agree so far
    order = np.argsort(group, kind="stable")
    tied = np.append(False, group[order][1:] == group[order][:-1]) if n else np.empty(0, bool)
    for k in range(SHALLOW // 8):
        run = np.cumsum(~tied)
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        w = words[order[at], k]
        by = np.lexsort((w, run[at]))
        order[at] = order[at[by]]
        w, r = w[by], run[at]
        tied[at] = np.append(False, (w[1:] == w[:-1]) & (r[1:] == r[:-1]))
    # deep: a blind trie for every group with a long common prefix
    heads = np.flatnonzero(~tied)
    for a, b in zip(heads.tolist(), np.append(heads[1:], n).tolist(), strict=True):
        if b - a > 1:
            members = order[a:b].copy()
            order[a:b] = members[blind_trie([own[i] for i in members.tolist()])]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        for a in range(1, n, 4096):
            x, y = order[a - 1 : min(a + 4096, n) - 1], order[a : a + 4096]
            differ = matrix[x] != matrix[y]
            first = np.where(differ.any(1), differ.argmax(1), width)
            same_group = group[x] == group[y]
            lcp[a : a + 4096] = np.where(same_group, np.minimum(first, np.minimum(size[x], size[y])), -1)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank[same], lcp


def repeated_windows(left: tuple, right: tuple, least: np.ndarray, most: np.ndarray, length: int, some: np.ndarray):
    """For each o: rows of ``some`` whose window o bytes before the anchor is repeated among the rows of their group.

    left and right are the sorted bytes before each anchor, backwards, and from it
    on (as of deep_shallow); windows of a row exist for least <= o <= most. Yields
    (o, rows with a window, their class, whether repeated).
    """
    (lrank, llcp), (rrank, rlcp) = left, right
    some = some[least[some] <= most[some]]
    if not len(some):
        return
    for o in range(int(least[some].min()), int(most[some].max()) + 1):
        rows = some[(least[some] <= o) & (o <= most[some])]
        if not len(rows):
            continue
        lc = np.cumsum(llcp < o)
        rc = np.cumsum(rlcp < length - o)
        key = lc[lrank[rows]] * np.int64(len(rlcp) + 1) + rc[rrank[rows]]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        yield o, rows, inverse, count[inverse] > 1


def _pair_windows(left: tuple, right: tuple, least: np.ndarray, most: np.ndarray, length: int, x: np.ndarray, y: np.ndarray):
    """(lowest, highest o) at which the windows of rows x and y, the only ones of their groups, are equal."""

    def common(rank, lcp):
        a, b = rank[x], rank[y]
        return np.where(a == b, np.int64(1 << 40), lcp[np.maximum(a, b)])

    lo = np.maximum(np.maximum(least[x], least[y]), length - common(*right))
    return lo, np.minimum(np.minimum(most[x], most[y]), common(*left))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def _solver(lengths: tuple[int, ...], rows_at_once: int = AT_ONCE):
    """Groups of anchors in, out: repeated runs of windows, and of dealt groups what other tasks must know."""

    def solve(df: pd.DataFrame):
        p, t, seg = df["p"].to_numpy(np.int64), df["t"].to_numpy(), df["seg"].tolist()
        reach = p - df["start"].to_numpy(np.int64)
        group, dealt, salt = df["g"].to_numpy(), df["salts"].to_numpy() > 1, df["salt"].tolist()
        left = deep_shallow(group, [s[:m][::-1] for s, m in zip(seg, reach.tolist(), strict=True)])
        right = deep_shallow(group, [s[m:] for s, m in zip(seg, reach.tolist(), strict=True)])
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        count = np.diff(np.append(first, len(group)))
        twos = first[(count == 2) & ~dealt[first]]
        more = np.flatnonzero(np.repeat((count > 2) | dealt[first], count))
        out = {"k": [], "t": [], "first": [], "last": []}
        told = {"k": [], "t": [], "first": [], "last": [], "core": [], "known": [], "salt": [], "windows": []}

        def add(k, rows, lo, hi):
            out["k"].append(np.full(len(rows), k))
            out["t"].append(t[rows])
            out["first"].append(p[rows] - hi)
            out["last"].append(p[rows] - lo)

        for k, length in enumerate(lengths):
            least, most = p - df[f"b{k}"].to_numpy(np.int64), p - df[f"a{k}"].to_numpy(np.int64)
            none = df[f"b{k}"].to_numpy() < 0
            least[none], most[none] = 1 << 40, -1
            lo, hi = _pair_windows(left, right, least, most, length, twos, twos + 1)
            for rows in (twos, twos + 1):
                add(k, rows[lo <= hi], lo[lo <= hi], hi[lo <= hi])
            if not len(more):
                continue
            spot = np.full(len(df), -1)
            spot[more] = np.arange(len(more))
            wide = int(most[more].max(initial=-1)) + 1
            found, tell = np.zeros((len(more), wide + 1), bool), np.zeros((len(more), wide + 1), bool)
            for o, rows, cls, rep in repeated_windows(left, right, least, most, length, more):
                found[spot[rows], o] = rep
                if dealt[rows].any():
                    one = np.zeros(len(rows), bool)
                    one[np.unique(cls, return_index=True)[1]] = True  # one of each class speaks for it
                    tell[spot[rows], o] = (one | ~rep) & dealt[rows]
            edge = np.diff(found.astype(np.int8), axis=1, prepend=0)
            r, lo = np.nonzero(edge == 1)
            _, hi = np.nonzero(edge == -1)
            add(k, more[r], lo, hi - 1)
            step = min(STEP, max(1, length // 4))
            for i in np.flatnonzero(tell.any(1)).tolist():
                at = more[i]
                buf = np.frombuffer(seg[at], np.uint8)
                whole = _hashes(buf, length, 5).view(np.int64)
                core = _hashes(buf, length - step + 1, 9).view(np.int64)
                for j in np.unique(np.flatnonzero(tell[i]) // step).tolist():
                    os = np.arange(j * step, min((j + 1) * step, wide))
                    os = os[tell[i, os]]
                    for known in (False, True):
                        own = os[found[i, os] == known]
                        for some in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1) if len(own) else ():
                            told["k"].append(k)
                            told["t"].append(t[at])
                            told["first"].append(int(p[at] - some[-1]))
                            told["last"].append(int(p[at] - some[0]))
                            told["core"].append(int(core[reach[at] - j * step]) ^ j)
                            told["known"].append(known)
                            told["salt"].append(salt[at])
                            told["windows"].append(np.stack([some, whole[reach[at] - some]], 1).reshape(-1))
        runs = pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})
        n = len(runs)
        runs["core"], runs["known"], runs["salt"], runs["windows"] = pd.array([None] * n, "Int64"), True, -1, pd.Series([None] * n, dtype=object)
        if not told["k"]:
            return runs
        told["core"] = pd.array(told["core"], "Int64")
        told["windows"] = pd.Series(told["windows"], dtype=object)
        return pd.concat([runs, pd.DataFrame(told)], ignore_index=True) if n else pd.DataFrame(told)

    def run(frames):
        held = []
        count = 0
        for pdf in frames:
            held.append(pdf)
            count += len(pdf)
            if count < rows_at_once:
                continue
            df = pd.concat(held, ignore_index=True)
            last = (df["h"] != df["h"].iloc[-1]) | (df["salt"] != df["salt"].iloc[-1])
            whole = int(np.flatnonzero(last.to_numpy())[-1]) + 1 if last.any() else 0
            if whole:
                if len(out := solve(_numbered(df.iloc[:whole]))):
                    yield out
                trim()
            held, count = [df.iloc[whole:]], len(df) - whole
        df = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(df) and len(out := solve(_numbered(df))):
            yield out

    return run


def _numbered(df: pd.DataFrame) -> pd.DataFrame:
    new = (df["h"].diff() != 0) | (df["salt"].diff() != 0)
    return df.assign(g=np.cumsum(new.to_numpy()))


def _finisher(lengths: tuple[int, ...], kept_as: str | None):
    """What is left of a text without its repeated runs of windows; null where there are none."""
    kind = "n_removed long, n_spans long, kept_sha256 string, n_repeated long" + f", kept {kept_as}, spans array<long>" * bool(kept_as)

    @F.pandas_udf(kind)
    def finish(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for raw, own in zip(text, runs, strict=True):
            if raw is None or own is None:
                out.append((None,) * (6 if kept_as else 4))
                continue
            raw = raw.encode("utf-8", "surrogatepass")
            masks = []
            for k, length in enumerate(lengths):
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, [r["first"] for r in own if r["k"] == k], 1)
                np.add.at(edge, [r["last"] + length for r in own if r["k"] == k], -1)
                masks.append(np.cumsum(edge)[:-1] > 0)
            gone = masks[-1]
            starts, ends = _runs(gone)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            row = (int(gone.sum()), len(starts), hashlib.sha256(kept).hexdigest(), int(masks[0].sum()))
            if kept_as:
                row += (kept.decode("utf-8", "ignore") if kept_as == "string" else kept, [x for s in zip(starts.tolist(), (ends + 1).tolist(), strict=True) for x in s])
            out.append(row)
        names = [c.split()[0] for c in kind.split(", ")]
        frame = pd.DataFrame(out, columns=names, dtype=object)
        for c in ("n_removed", "n_spans", "n_repeated"):
            frame[c] = frame[c].astype("Int64")
        return frame

    return finish


def repeated_substrings(
    docs: DataFrame, *, length: int = 400, passage: int | None = None, crowd: int = 2048, kept_as: str | None = None, carry: list[str] | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated[, kept, spans, was_null]) for every row of ``docs`` (doc_id, text).

    A byte is removed if a string of ``length`` bytes that covers it also starts at
    another place of any text, its own included. Texts are judged as given, not
    after removals. ``n_repeated`` counts the bytes that are covered so by strings
    of ``passage`` bytes (``length`` if not given, and never more). A null text is empty. ``carry`` names columns to
    pass on. Rows are texts of their own, also with equal or null doc_ids. ``spans``
    lists begin and end of what was removed. ``kept_as`` asks for what is left: as
    ``binary``, the exact bytes, or as ``string``, without the rest of characters that
    a cut has broken. Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    lengths = tuple(sorted({min(passage or length, length), length}))
    gram = min(GRAM, max(1, lengths[0] // 2))
    carry = carry or []
    rows = docs.select("doc_id", *carry, F.col("text").isNull().alias("was_null"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    long_rows = rows.where(F.col("n_bytes") >= lengths[0]).withColumn("t", F.unhex(F.md5("text")))
    # equal texts are one; copies meet map-side, and a text is dealt out only here
    own = F.struct("doc_id", *carry, "text")
    texts = bucketed(long_rows.groupBy("t").agg(F.first(own).alias("x"), F.count("*").alias("copies")).select("t", "copies", "x.*"), "texts", "t")

    ranges = [f"{c}{k}" for k in range(len(lengths)) for c in "ab"]

    def find(frames):
        for pdf in frames:
            for part in rows_in_blocks(iter([pdf]), "text", 4 << 20):
                out = anchors(encoded(part["text"]), lengths, gram)
                t = part["t"].to_numpy()
                for begin in range(0, len(out), 20000):
                    some = out.iloc[begin : begin + 20000]
                    yield some.assign(t=t[some["i"].to_numpy()]).drop(columns="i")

    numbers = "".join(f", {c} long" for c in ranges)
    places, places_at = staged_at(texts.select("t", "text").mapInPandas(find, f"t binary, p long, h long{numbers}"), "anchors")
    # written first, so that the join below deals both sides anew and a common gram can be split
    often, often_at = staged_at(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    salts = F.ceil(F.col("n") / crowd)
    salt = F.when(salts > 1, F.pmod(F.xxhash64("t", "p"), salts)).otherwise(0).cast("int").alias("salt")
    mine = places.join(often, "h").select("t", F.struct("h", "p", *ranges, salt, salts.cast("int").alias("salts")).alias("x"))
    listed, listed_at = staged_at(mine.groupBy("t").agg(F.collect_list("x").alias("xs")), "listed")
    discard(spark, places_at, often_at)

    def cut(frames):
        names = ["h", "salt", "salts", "p", *ranges]
        for pdf in frames:
            texts_here = encoded(pdf["text"])
            count = pdf["h"].map(len).to_numpy()
            owner = np.repeat(np.arange(len(pdf)), count)
            every = {c: np.concatenate(pdf[c].to_list()) for c in names} if len(pdf) else {}
            t = pdf["t"].to_numpy()
            for begin in range(0, len(owner), AT_ONCE):
                out = pd.DataFrame({c: v[begin : begin + AT_ONCE] for c, v in every.items()})
                own = owner[begin : begin + AT_ONCE]
                first, last = out["a0"].to_numpy(), out["b0"].to_numpy() + lengths[0]
                for k in range(1, len(lengths)):
                    has = out[f"b{k}"].to_numpy() >= 0
                    first = np.where(has, np.minimum(first, out[f"a{k}"]), first)
                    last = np.where(has, np.maximum(last, out[f"b{k}"] + lengths[k]), last)
                out.insert(3, "t", t[own])
                out["start"] = first
                out["seg"] = [texts_here[i][x:y] for i, x, y in zip(own.tolist(), first.tolist(), last.tolist(), strict=True)]
                yield out

    xs = [f"xs.{c}" for c in ("h", "salt", "salts", "p", *ranges)]
    segments = texts.select("t", "text").join(listed, "t").select("t", "text", *xs).mapInPandas(
        cut, f"h long, salt int, salts int, t binary, p long{numbers}, start long, seg binary"
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    solved, _ = staged_at(
        segments.repartition(parts, "h", "salt")
        .sortWithinPartitions("h", "salt")
        .mapInPandas(_solver(lengths), "k int, t binary, first long, last long, core long, known boolean, salt int, windows array<long>"),
        "solved",
    )
    discard(spark, listed_at)
    runs = solved.where("core is null").select("t", "k", "first", "last")
    # between tasks: a block that several rows tell is repeated as a whole, and speaks once for what is left
    told = solved.where("core is not null").withColumn("block", F.xxhash64("windows"))
    blocks = staged(
        told.groupBy("core", "k", "block").agg(
            F.count("*").alias("n"),
            (F.max("known") | (F.count("*") > 1)).alias("settled"),
            F.min("salt").alias("low"),
            F.max("salt").alias("high"),
            F.first(F.struct("t", "last", "windows")).alias("x"),
        ),
        "blocks",
    )
    alike = blocks.where("n > 1").select("core", "k", "block")
    at_once = told.where("not known").join(alike, ["core", "k", "block"]).select("t", "k", "first", "last")
    # then the windows of different blocks with one core, if several tasks tell them and some block is open
    cores = blocks.groupBy("core", "k").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("settled").alias("settled"))
    cores = cores.where("n > 1 and low < high and not settled").select("core", "k")
    pairs = F.expr("transform(sequence(0, cast(size(windows) / 2 as int) - 1), i -> struct(windows[2 * i] - windows[0] as d, windows[2 * i + 1] as w))")
    windows = staged(
        blocks.select("core", "k", "settled", "x.*")
        .join(cores, ["core", "k"])
        .select("t", "core", "k", "settled", "last", F.explode(pairs).alias("x"))
        .select("t", "core", "k", "settled", (F.col("last") - F.col("x.d")).alias("s"), F.col("x.w").alias("w")),
        "windows",
    )
    twice = windows.groupBy("core", "k", "w").agg(F.count("*").alias("n")).where("n > 1").select("core", "k", "w")
    late = windows.where("not settled").join(twice, ["core", "k", "w"]).select("t", "k", F.col("s").alias("first"), F.col("s").alias("last"))
    late = late.unionByName(at_once)
    by_text = runs.unionByName(late).groupBy("t").agg(F.collect_list(F.struct("k", "first", "last")).alias("runs"))

    size, none = F.col("n_bytes"), F.array().cast("array<bigint>")
    columns = ["doc_id", *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"] + ["kept", "spans", "was_null"] * bool(kept_as)
    whole_text = F.col("text").cast(kept_as or "binary")
    untouched = {"n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.sha2("text", 256)}
    short = rows.where(size < lengths[0]).withColumns(untouched | {"n_repeated": F.lit(0).cast("long"), "kept": whole_text, "spans": none})
    # texts that occur once: the buckets meet their runs
    finish = _finisher(lengths, kept_as)
    single = texts.where("copies = 1").join(by_text, "t", "left").withColumn("x", finish(F.when(F.col("runs").isNotNull(), F.col("text")), "runs"))
    done = {c: F.coalesce(f"x.{c}", v) for c, v in (untouched | {"n_repeated": F.lit(0).cast("long")}).items()}
    if kept_as:
        done |= {"kept": F.coalesce("x.kept", whole_text), "spans": F.coalesce("x.spans", none), "was_null": F.lit(False)}
    single = single.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumns(done)
    # texts that occur several times are repeated as a whole, if long enough; their rows need no text
    gone = size >= length
    copied = {
        "n_removed": F.when(gone, size).otherwise(0),
        "n_spans": F.when(gone, 1).otherwise(0).cast("long"),
        "kept_sha256": F.sha2(F.when(gone, F.lit("")).otherwise(F.col("text")), 256),
        "n_repeated": size,
        "kept": F.when(gone, F.lit("").cast(kept_as or "binary")).otherwise(whole_text),
        "spans": F.when(gone, F.array(F.lit(0).cast("long"), size)).otherwise(none),
    }
    many = texts.where("copies > 1").select("t")
    multiple = long_rows.withColumns(copied).select("t", *columns).join(many, "t")
    return short.select(*columns).unionByName(single.select(*columns)).unionByName(multiple.select(*columns))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for strings of 400 bytes; ``n_repeated`` and ``repeats`` tell of passages of 200 bytes or more.

    A passage of over 50 words may well be shorter than 400 bytes.
    """
    out = repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=400, passage=200)
    return out.withColumn("repeats", F.col("n_repeated") > 0)
