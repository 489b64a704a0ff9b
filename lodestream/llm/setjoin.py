"""Exact similarity joins of texts by their distinct character pieces (Jaccard at least ``t``).

T-occurrence search by DivideSkip, laid out for shuffles. A partner of a text with n pieces has at least T of them. The lists
of its pieces are ordered by length; the L longest are skipped, with L by the cost model of the method, and the n - L
shortest are merged by one sort on the piece. Each meeting of two texts in a short list is an occurrence; pairs with at least
T - L of them are candidates, and the long lists are not merged but probed: a candidate's pieces are looked up by binary search in
its partner's sorted pieces, and what reaches the threshold by hashes is decided on the texts themselves.
Meetings that sizes, ranks or sketches rule out are not counted; a pair that reaches ``t`` has none of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.textkeys import HASH_BITS, codes, distinct_windows, mix, pieces, runs, split_windows
from lodestream.session import materialize, spread

WIDTH = 5
#: Places of the hashed table of piece counts: PER_TEXT for each text, between these bounds. It only orders the lists.
PER_TEXT, FEWEST, MOST = 16, 1 << 18, 1 << 25
#: Places of that table in one batch.
COUNTED = 1 << 20
#: Longest list compared by one task; longer ones are split into blocks.
BLOCK = 4096
#: Pairs compared at once.
CHUNK = 1 << 20
#: Cost of probing a list against merging it, in the cost model L = T / (MU log2 M + 1), M being the longest list.
MU = 0.0085
#: Set sizes up to which sketches have 256, 512 and 1,024 bits; larger sets have 2,048.
SIZES = np.array([160, 256, 640])
#: ``place`` holds side, n and rank, as rows of few columns cost the shuffle less.
POSTING = "key bigint, rid bigint, place bigint, sk binary"


def bucket_counts(df: DataFrame) -> np.ndarray:
    """Counts of hashed pieces over all texts (canon, role), as an array (2, places) by role (0 or 1).

    Its size grows with the number of texts up to MOST, so it may be sent everywhere.
    """
    want = PER_TEXT * df.count()
    size = min(MOST, max(FEWEST, 1 << max(want - 1, 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(2 * size, dtype=np.int32)  # pages that no count falls in are never touched
        for b in batches:
            texts, role = b.column("canon").to_pylist(), b.column("role").to_numpy().astype(np.int64)
            for part in runs(texts):
                text, h = split_windows(distinct_windows(texts[part], WIDTH))
                at = np.sort(_place(h, size) + role[part][text] * size)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
                acc[at[first]] += np.diff(np.r_[first, len(at)]).astype(np.int32)  # costs as much as the run has pieces, whatever the table's size
        for start in range(0, len(acc), COUNTED):
            hit = np.flatnonzero(acc[start : start + COUNTED]) + start
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(acc[hit].astype(np.int64))], ["b", "n"])

    got = df.select("canon", "role").mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    at = got.select(F.col("b").cast("int"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    table = np.zeros(2 * size, dtype=np.int32)
    table[at["b"].to_numpy()] = at["n"].to_numpy()
    return table.reshape(2, size)


def _place(h: np.ndarray, size: int) -> np.ndarray:
    return (h & np.uint64(size - 1)).astype(np.int64)


def sketches(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bits of the set of each text, 256 to 2,048 by its size n; two sets' sketches of one length differ in at most as many
    bits as the sets in elements. A longer sketch folds to a shorter one, as its halves add up (xor)."""
    bits = 256 << np.searchsorted(SIZES, n)
    base = np.cumsum(bits) - bits
    at = (h >> np.uint64(17)).astype(np.int64) & (bits[text] - 1)
    data = np.packbits((np.bincount(base[text] + at, minlength=int(bits.sum())) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, np.cumsum(bits // 8)].astype(np.int32)), pa.py_buffer(data)])


def _folded(sketches: pa.Array, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(class of each row, words by row of its sketch at each class up to its own), rows in ``order``. Sketches are whole units of 256 bits."""
    off = np.frombuffer(sketches.buffers()[1], dtype=np.int32)[sketches.offset : sketches.offset + len(sketches) + 1] // 32
    raw = np.frombuffer(sketches.buffers()[2], dtype=np.uint64, count=4 * off[-1]).reshape(-1, 4)
    kind, first = np.log2(np.maximum(np.diff(off), 1)).astype(np.int8)[order], off[:-1][order]
    out: list[np.ndarray] = []
    for k in range(len(SIZES), -1, -1):
        words = np.zeros((4 << k, len(kind)), dtype=np.uint64)
        wider = np.flatnonzero(kind > k)
        if len(wider):
            words[:, wider] = out[0][: 4 << k, wider] ^ out[0][4 << k :, wider]
        own = np.flatnonzero(kind == k)
        if len(own):
            words[:, own] = raw[first[own][:, None] + np.arange(1 << k)].reshape(len(own), -1).T
        out.insert(0, words)
    return kind, out


def _far(words: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs' sketches differ in at most ``most`` bits."""
    bits = np.zeros(len(left), dtype=np.int16)
    for word in words:
        bits += np.bitwise_count(word[left] ^ word[right])
    return bits <= most


def least_overlap(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Overlap from which on two sets of these sizes have Jaccard ``t``."""
    return np.ceil((a + b) * (t / (1 + t)) - 1e-9)


def short_lists(n: np.ndarray, t: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of short lists n - L, occurrences T - L) of texts with n pieces, where L = T / ratio and at most T - 1."""
    least = np.ceil(t * n - 1e-9).astype(np.int64)
    skipped = np.clip(np.minimum((least / ratio).astype(np.int64), least - 1), 0, None)
    return n - skipped, np.maximum(least - skipped, 1)


def cost_ratio(longest: int) -> float:
    """What T is divided by for L."""
    return MU * float(np.log2(longest + 2)) + 1


def _cells(key: np.ndarray, count: np.ndarray, rid: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of posting, key, side): postings of long lists go to all cells that pair their block with another."""
    blocks = -(-count.astype(np.int64) // BLOCK)
    one = np.flatnonzero(blocks <= 1)
    more = np.flatnonzero(blocks > 1)
    if not len(more):
        return one, key, side
    m = blocks[more]
    at = np.repeat(more, m)
    y = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
    x = (mix(rid[at].view(np.uint64)) % blocks[at].astype(np.uint64)).astype(np.int64)
    s = side[at]
    lo, hi = np.where(s == 1, x, np.where(s == 2, y, np.minimum(x, y))), np.where(s == 1, y, np.where(s == 2, x, np.maximum(x, y)))
    with np.errstate(over="ignore"):
        cell = mix(key[at] ^ mix(lo.astype(np.uint64) * np.uint64(1_000_003) + hi.astype(np.uint64) + np.uint64(1)))
    s = np.where(s > 0, s, np.where(y == x, 0, np.where(x < y, 1, 2)))
    return np.concatenate([one, at]), np.concatenate([key[one], cell]), np.concatenate([side[one], s.astype(np.int8)])


def _postings(df: DataFrame, cost: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], t: float, ratio: float) -> DataFrame:
    """Postings of the short lists of texts (rid, canon, role).

    ``cost`` gives, for hashes and roles, the work by which lists are ordered, the length of the longer side, and whether the list joins anything.
    """
    schema = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("place", pa.int64()), ("sk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, role, rid = b.column("canon").to_pylist(), b.column("role").to_numpy(), b.column("rid").to_numpy()
            for part in runs(texts):
                text, h = split_windows(distinct_windows(texts[part], WIDTH))
                n = np.bincount(text, minlength=len(texts[part]))
                work, count, joins = cost(h, role[part][text].astype(np.int64))
                # text, then work on a fine scale, then hash: one order of pieces for all texts
                level = (np.log2(work + 1.0) * 1024).astype(np.uint64)
                order = np.argsort(text.astype(np.uint64) << np.uint64(HASH_BITS) | level << np.uint64(32) | h >> np.uint64(HASH_BITS - 32), kind="stable")
                pos = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                kept = np.flatnonzero((pos < short_lists(n, t, ratio)[0][text]) & joins[order])
                few, pos = order[kept], pos[kept]
                if len(few):
                    x = text[few]
                    at, key, side = _cells(h[few], count[few], rid[part][x], role[part][x].astype(np.int8))
                    x = x[at]
                    sk = sketches(text, h, n).take(pa.array(x))
                    place = side.astype(np.int64) << 60 | n[x] << 30 | pos[at]  # n and pos below 2^30
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rid[part][x]), pa.array(place), sk], schema=schema)

    return df.select("rid", "canon", "role").mapInArrow(run, POSTING)


def _pairs(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with lo[i] <= j < hi[i], in chunks."""
    size = np.maximum(hi - lo, 0)
    ends = np.cumsum(size)
    i0 = 0
    while i0 < len(size):
        base = ends[i0 - 1] if i0 else 0
        i1 = max(i0 + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        part = size[i0:i1]
        left = np.repeat(np.arange(i0, i1), part)
        if len(left):
            start = np.repeat(np.cumsum(part) - part, part)
            yield left, np.arange(len(left)) - start + lo[left]
        i0 = i1


def _occurring(postings: DataFrame, t: float, ratio: float, parts: int, same: bool) -> DataFrame:
    """Pairs (a, b) of texts that occur in enough short lists: at least T - L times, for the smaller text's T and L.

    Sides 1 and 2 of a key are compared with each other, side 0 with itself; a < b if all texts are of the ``same`` table. A piece of rank p among the n of
    a text, rarest first, is followed by n - p - 1 others; so if it is the c-th common piece of a pair at the latest, n - p must reach the
    overlap less c - 1, for both texts. As ranks (p - c + 1) / n this bounds the partner's rank, and postings are sorted by it. Pairs whose
    sketches differ too much are not counted.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("seen", pa.int32()), ("want", pa.int32())])
    share = t / (1 + t)

    def flush(x: dict[str, np.ndarray], marks: pa.Array) -> Iterator[pa.RecordBatch]:
        key, rid = x["key"], x["rid"]
        side, n, pos = x["place"] >> 60, x["place"] >> 30 & (1 << 30) - 1, x["place"] & (1 << 30) - 1
        if not len(key):
            return
        want = short_lists(n, t, ratio)[1]
        f = (pos - want + 1) / n
        # rows come by key; one number for key, side and rank, which lies in -1 to 1
        order = np.argsort(np.cumsum(np.r_[False, key[1:] != key[:-1]]) * 3 + side + (f + 4) / 8)
        key, side, rid, n, pos, f, want = (v[order] for v in (key, side, rid, n, pos, f, want))
        kind, words = _folded(marks, order)
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])])
        end = np.r_[start[1:], len(key)]
        seg = np.repeat(np.arange(len(start)), end - start)
        # 1 - f_a >= share (1 + r) and 1 - f_b >= share (1 + 1 / r) for the ratio r of sizes
        room = (1 - f) / share - 1
        with np.errstate(divide="ignore"):
            bound = np.where(room > 0, 1 - share * (1 + 1 / np.maximum(room, 1e-9)), -np.inf) + 1e-8
        nxt = np.minimum(seg + 1, len(start) - 1)
        meets = (side == 1) & (nxt > seg) & (key[start[nxt]] == key) & (side[start[nxt]] == 2)
        to = np.where(side == 0, seg, np.where(meets, nxt, -1))
        lo = np.where(to >= 0, start[to], 0)
        hi = np.searchsorted(seg + (f + 4) / 8, to + np.clip((bound + 4) / 8, 0, 0.999), side="right")  # ranks lie in -1 to 1
        hi = np.where(to < 0, 0, np.where(side == 0, np.minimum(hi, np.arange(len(key))), np.minimum(np.maximum(hi, lo), end[to])))
        kept: list[np.ndarray] = []
        after, few = (n - pos - 1).astype(np.int32), want.astype(np.int32)
        size = n * share
        for left, right in _pairs(lo, hi):
            ok = np.minimum(after[left], after[right]) + np.minimum(few[left], few[right]) >= size[left] + size[right] - 1e-9
            left, right = left[ok], right[ok]
            other = rid[left] != rid[right]
            left, right = left[other], right[other]
            most = (n[left] + n[right] - 2 * least_overlap(n[left], n[right], t)).astype(np.int64)
            level = np.minimum(kind[left], kind[right])
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                for w in ([k - 1] if k else []) + [k]:
                    at = at[_far(words[w], left[at], right[at], most[at])]
                if len(at):
                    kept.append(np.stack([rid[left[at]], rid[right[at]], np.minimum(want[left[at]], want[right[at]])]))
        if kept:
            p = np.concatenate(kept, axis=1)
            if same:
                p[:2] = np.sort(p[:2], axis=0)
            p, seen = np.unique(p, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), pa.array(seen.astype(np.int32)), pa.array(p[2].astype(np.int32))], schema=schema)

    names = ["key", "rid", "place"]

    def joined(held: list[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], pa.Array]:
        tab = pa.Table.from_batches(held)
        return {c: tab.column(c).to_numpy() for c in names}, tab.column("sk").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            last = b.column("key")[b.num_rows - 1].as_py()
            if size >= 150_000 and held[0].column("key")[0].as_py() != last:
                x, sk = joined(held)
                at = int(np.searchsorted(x["key"], last, side="left"))
                yield from flush({c: v[:at] for c, v in x.items()}, sk[:at])
                held = [h for h in pa.Table.from_batches(held).slice(at).combine_chunks().to_batches()]
                size = sum(h.num_rows for h in held)
        if size:
            yield from flush(*joined(held))

    near = postings.repartition(parts, "key").sortWithinPartitions("key")
    met = near.mapInArrow(run, "a bigint, b bigint, seen int, want int").groupBy("a", "b").agg(F.sum("seen").alias("seen"), F.max("want").alias("want"))
    return met.where("seen >= want").select("a", "b")


def representatives(texts: DataFrame, roles: bool = False) -> DataFrame:
    """One row for each distinct canonical text: ``rid, ckey, canon, role``. Copies merge before anything is compared."""
    keys = ["ckey", "role"] if roles else ["ckey"]
    r = texts.groupBy(*keys).agg(F.first("canon").alias("canon"))
    rid = F.conv(F.substring(F.hex("ckey"), 1, 15), 16, 10).cast("bigint")
    r = r.withColumn("rid", rid)
    return (r if roles else r.withColumn("role", F.lit(0))).select("rid", "ckey", "canon", F.col("role").cast("tinyint").alias("role"))


def banded_distance(a: str, b: str, k: int) -> int | None:
    """Edit distance of two texts if it is at most ``k``; None beyond. Dynamic programming inside a band of 2 k + 1 diagonals."""
    if abs(len(a) - len(b)) > k:
        return None
    x, y = codes(a), codes(b)
    far = k + 1
    band = np.arange(-k, k + 1)  # column j = i + band in row i
    row = np.where(band >= 0, band, far)
    row = np.where(band <= len(y), row, far)
    for i in range(1, len(x) + 1):
        j = i + band
        inside = (j >= 1) & (j <= len(y))
        same = np.zeros(len(band), dtype=bool)
        same[inside] = y[j[inside] - 1] == x[i - 1]
        new = np.minimum(np.where(inside, row + ~same, far), np.r_[row[1:], far] + 1)
        new = np.where(j == 0, i, np.where(j < 0, far, np.where(j > len(y), far, new)))
        new = np.minimum(np.minimum.accumulate(new - band) + band, far)  # insertions run along the row
        row = np.where((j < 0) | (j > len(y)), far, new)
        if row.min() > k:
            return None
    d = int(row[len(y) - len(x) + k])
    return d if d <= k else None


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, t: float, width: int = WIDTH, band: float = 0.0) -> DataFrame:
    """``ckey_a, ckey_b, overlap, jaccard, edits`` of the candidate pairs (a, b) that reach ``t`` exactly.

    The pieces of one text are probed, by binary search, in the sorted pieces of the other; what reaches ``t`` by hashes, of
    which equal ones can only add, is counted on the pieces themselves. ``edits`` is the edit distance if
    it is at most the share ``band`` of the longer text, else null, as where stretches have moved.
    """
    x = pairs.join(left.select(F.col("rid").alias("a"), F.col("ckey").alias("ckey_a"), F.col("canon").alias("x")), "a")
    x = x.join(right.select(F.col("rid").alias("b"), F.col("ckey").alias("ckey_b"), F.col("canon").alias("y")), "b")

    def likely(p: list[str], q: list[str]) -> np.ndarray:
        g, h = distinct_windows(p, width), distinct_windows(q, width)
        at = np.searchsorted(h, g)
        hit = split_windows(g[h[np.minimum(at, len(h) - 1)] == g] if len(h) else h)[0]
        n, o = (np.bincount(v, minlength=len(p)) for v in (np.r_[split_windows(g)[0], split_windows(h)[0]], hit))
        return np.flatnonzero((o > 0) & (o >= (t - 1e-9) * (n - o)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            left, right = b["x"].tolist(), b["y"].tolist()
            rows = []
            for part in runs([p + q for p, q in zip(left, right, strict=True)]):
                for i in likely(left[part], right[part]) + part.start:
                    g, h = pieces(left[i], width), pieces(right[i], width)
                    o = len(g & h)
                    j = o / (len(g) + len(h) - o)
                    if j >= t:
                        rows.append((i, o, j, banded_distance(left[i], right[i], int(band * max(len(left[i]), len(right[i])))) if band else None))
            at, over, jac, edits = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield b[["ckey_a", "ckey_b"]].iloc[list(at)].assign(overlap=over, jaccard=jac, edits=pd.array(edits, dtype="Int32"))

    return x.select("ckey_a", "ckey_b", "x", "y").mapInPandas(run, "ckey_a binary, ckey_b binary, overlap int, jaccard double, edits int")


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tjoin(reps: DataFrame, t: float = 0.5) -> DataFrame:
    """All pairs of distinct texts with Jaccard of their 5-character pieces at least ``t``: ``ckey_a, ckey_b, overlap, jaccard, edits`` (null).

    For a text of n pieces every partner shares at least T = ceil(t n) of them. In one order of all pieces, by hashed counts (which keeps
    the merged lists short; any order gives the full result), at most max(L_a, L_b) common pieces of a pair lie outside
    both short parts, so at least T - L of the rest meet. Texts with fewer than 5 characters have no pieces and no partners here.
    """
    reps = materialize(reps, "tjoin-reps")
    wide = spread(reps)
    table = bucket_counts(wide)[0].copy()
    ratio = cost_ratio(int(table.max(initial=0)))
    counts = reps.sparkSession.sparkContext.broadcast(table)

    def cost(h: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = counts.value[_place(h, len(counts.value))].astype(np.int64)
        return c, c, c > 1  # a piece of one text joins nothing

    cand = materialize(_occurring(_postings(wide, cost, t, ratio), t, ratio, _parts(reps), True), "tjoin-pairs")
    return verified(spread(cand), reps, reps, t)


def cross_join(reps: DataFrame, t: float = 0.5, band: float = 0.0) -> DataFrame:
    """Pairs of an evaluation text (role 1, a) and a training text (role 2, b) with Jaccard at least ``t``; columns of ``verified``.

    The same bound between two sides; it holds for every length, edit and repetition. Pieces are ordered by the hashed count in role 1 times that in
    role 2, so pieces of one role only come first; they join nothing and are dropped. Equal texts of both roles are no pair here.
    """
    reps = materialize(reps, "crossjoin-reps")
    wide = spread(reps)
    table = bucket_counts(wide.withColumn("role", F.col("role") - 1))
    ratio = cost_ratio(int(table.max(initial=0)))
    counts = reps.sparkSession.sparkContext.broadcast(table)

    def cost(h: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = counts.value[:, _place(h, counts.value.shape[1])].astype(np.int64)
        work = c[0] * c[1]
        return work, c.max(axis=0), work > 0

    cand = materialize(_occurring(_postings(wide, cost, t, ratio), t, ratio, _parts(reps), False), "crossjoin-pairs")
    return verified(spread(cand), reps.where("role = 1"), reps.where("role = 2"), t, band=band)
