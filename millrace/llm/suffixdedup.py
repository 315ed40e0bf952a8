"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH = 400
#: Bytes of an anchor; each string of LENGTH bytes holds a chosen one.
ANCHOR = 256
#: Period of the difference cover.
PERIOD = 64
#: Contexts sorted at once in a task; an anchor with more distinct contexts is counted by
#: window hashes instead.
BLOCK = 2000
HOT = 4_000

_ROOT = round(PERIOD**0.5)
#: Every difference mod PERIOD is one of two members: d = a*_ROOT - b.
COVER = sorted({*range(_ROOT), *range(0, PERIOD, _ROOT)})
#: [i, j] -> shift d with i + d and j + d in the cover (mod PERIOD).
SHIFT = np.array(
    [[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)]
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Powers:
    """Powers of the hash base and of its inverse mod 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = np.full(size, _BASE, np.uint64), np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def window_hashes(raw: bytes, width: int) -> np.ndarray:
    """A hash of the bytes at each start of a window."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _POWERS.get(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * up[:-1], out=total[1:])
    h = (total[width:] - total[:-width]) * down[: len(b) - width + 1]
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _sliding(x: np.ndarray, w: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over each window of w values, in linear time."""
    n = len(x) - w + 1
    pad = np.concatenate([x, np.repeat(x[-1:], -len(x) % w)]).reshape(-1, w)
    head = of.accumulate(pad, axis=1).ravel()
    tail = of.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(tail[:n], head[w - 1 : w - 1 + n])


def anchors(raw: bytes, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, least hash of each start) of the anchors: minima of some window.

    A string of ``length`` bytes holds the minimum of its own anchors' hashes, so equal
    strings hold equal chosen anchors at equal offsets.
    """
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = window_hashes(raw, anchor)
    w = length - anchor + 1
    low = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), w, np.maximum) == h)
    return at, h[at], low


def sort_block(anchor: np.ndarray, at: np.ndarray, contexts: list[bytes], starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its starts 0..starts[i]-1 have an equal string of
    ``length`` bytes in another context of the same anchor.

    Equal strings hold their anchor at the same offset, so a suffix bucket is an anchor
    and the offset to it (``at`` is the anchor's place in each context); one start seen
    from two anchors of equal hash is never compared with itself.  The suffixes are sorted
    by bucket and first PERIOD bytes.  Ties are resolved by the
    ranks of the cover samples, which are computed once for the block by doubling.  Equal
    strings are then neighbours, and neighbours are compared byte by byte.
    """
    m, longest = len(contexts), max(map(len, contexts))
    width = -(-(longest + PERIOD) // PERIOD) * PERIOD + PERIOD
    text = np.zeros((m, width), np.uint8)
    for i, c in enumerate(contexts):
        text[i, : len(c)] = np.frombuffer(c, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(text, PERIOD, axis=1)

    def names(rows, cols):
        block = np.ascontiguousarray(view[rows, cols]).view(f"V{PERIOD}").ravel()
        return np.unique(block, return_inverse=True)[1].ravel()

    # ranks of the cover samples to a depth of at least ``length`` bytes
    offsets = np.array([o for o in range(width - PERIOD + 1) if o % PERIOD in COVER])
    rank = np.zeros((m, width + 1), np.int64)
    rank[:, offsets] = names(np.repeat(np.arange(m), len(offsets)), np.tile(offsets, m)).reshape(m, -1) + 1
    depth = PERIOD
    while depth < length:
        ahead = np.minimum(offsets + depth, width)
        code = rank[:, offsets] * (rank.max() + 1) + np.where(offsets + depth < width, rank[:, ahead], 0)
        rank[:, offsets] = np.unique(code, return_inverse=True)[1].reshape(code.shape) + 1
        depth *= 2

    row = np.repeat(np.arange(m), starts)
    col = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    first = names(row, col)
    residue = col % PERIOD
    own = SHIFT[residue, residue]
    bucket = anchor[row] * (length + 1) + at[row] - col
    order = np.lexsort((rank[row, col + own], residue, first, bucket))
    b, f = bucket[order], first[order]
    new = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (f[1:] != f[:-1])]))
    ends = np.append(new[1:], len(order))
    res = residue[order]
    mixed = np.flatnonzero(np.maximum.reduceat(res, new) != np.minimum.reduceat(res, new)) if len(new) else []
    for g in mixed:  # ties of suffixes that meet the cover at different shifts
        tie = order[new[g] : ends[g]].tolist()

        def compare(x, y):
            d = SHIFT[residue[x], residue[y]]
            return int(rank[row[x], col[x] + d]) - int(rank[row[y], col[y] + d])

        order[new[g] : ends[g]] = sorted(tie, key=cmp_to_key(compare))
    hit = np.zeros(len(order), bool)
    tied = np.flatnonzero((b[1:] == b[:-1]) & (f[1:] == f[:-1]))
    whole = np.lib.stride_tricks.sliding_window_view(text, length, axis=1) if width >= length else None
    for a in range(0, len(tied), 20_000):
        x, y = order[tied[a : a + 20_000]], order[tied[a : a + 20_000] + 1]
        same = (whole[row[x], col[x]] == whole[row[y], col[y]]).all(axis=1)
        hit[x[same]] = hit[y[same]] = True
    return np.split(hit, np.cumsum(starts)[:-1])


def _profiles(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            n, sha, single, double = [], [], [], []
            for raw in batch.column("raw"):
                raw = raw.as_py() or b""
                n.append(len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
                v, c = np.unique(anchors(raw, length, anchor)[1].view(np.int64), return_counts=True)
                single.append(v[c == 1])
                double.append(v[c > 1])
            lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]).astype(np.int32)), pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists(single), lists(double)],
                ["doc_id", "h1", "h2", "n_bytes", "sha", "once", "more"],
            )

    return docs.mapInArrow(make, "doc_id long, h1 long, h2 long, n_bytes long, sha string, once array<long>, more array<long>")


def _contexts(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Per text, anchor and distinct context: the positions it stands at and its bytes.

    Every start belongs to the first least anchor of its string; a context is what the
    strings of one anchor cover.
    """
    reach = length - anchor

    def make(batches):
        for batch in batches:
            out = {k: [] for k in ("h1", "h2", "v", "c1", "c2", "at", "skip", "context")}
            for i, raw in enumerate(batch.column("raw")):
                raw = raw.as_py()
                pos, h, low = anchors(raw, length, anchor)
                wanted = np.isin(h.view(np.int64), np.array(batch.column("values")[i].as_py(), np.int64))
                seen: dict[tuple, list] = {}
                last: dict[int, int] = {}
                for p, v in zip(pos[wanted].tolist(), h[wanted], strict=True):
                    v = int(v.view(np.int64))
                    a = max(0, p - reach, last.get(v, -1) + 1)
                    last[v] = p
                    own = np.flatnonzero(low[a : p + 1].view(np.int64) == v)
                    if not len(own):
                        continue
                    first, end = a + int(own[0]), a + int(own[-1]) + length
                    context = raw[first:end]
                    seen.setdefault((v, p - first, xxhash.xxh3_128_digest(context)), [context]).append(first)
                for (v, left, d), (context, *at) in seen.items():
                    row = (batch.column("h1")[i].as_py(), batch.column("h2")[i].as_py(), v, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), at, left, context)
                    for k, x in zip(out, row, strict=True):
                        out[k].append(x)
                if len(out["v"]) > 20_000:
                    yield pack(out)
                    for x in out.values():
                        x.clear()
            yield pack(out)

    types = {"at": pa.list_(pa.int64()), "skip": pa.int32(), "context": pa.binary()}

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array(x, types.get(k, pa.int64())) for k, x in out.items()], list(out))

    return texts.mapInArrow(make, "h1 long, h2 long, v long, c1 long, c2 long, at array<long>, skip int, context binary")


def _sorted_buckets(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """(v, c1, c2, skip, first, last): the outer starts of each context that are repeated.

    Strings at those cover all between: a context's starts are closer than their length.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        starts = np.array([len(r[4]) - length + 1 for r in rows])
        _, bucket = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        hits = sort_block(bucket, np.array([r[3] for r in rows]), [r[4] for r in rows], starts, length)
        ends = [np.flatnonzero(h | (r[5] > 1)) for h, r in zip(hits, rows, strict=True)]
        some = [k for k, e in enumerate(ends) if len(e)]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([rows[i][k] for i in some], pa.int64() if k < 3 else pa.int32()) for k in range(4)),
             *(pa.array([ends[i][k] for i in some], pa.int32()) for k in (0, -1))],
            ["v", "c1", "c2", "skip", "first", "last"],
        )

    def make(batches) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("v", "c1", "c2", "skip", "context", "copies")]
            for r in zip(*columns, strict=True):
                if len(rows) >= block and r[0] != rows[-1][0]:  # whole buckets only
                    yield flush(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield flush(rows)

    out = contexts.repartition("v").sortWithinPartitions("v")
    return out.mapInArrow(make, "v long, c1 long, c2 long, skip int, first int, last int")


def _hot_windows(contexts: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """The same for anchors with very many contexts: every window's hash is counted."""

    def make(batches):
        for batch in batches:
            out = {k: [] for k in ("v", "c1", "c2", "skip", "start", "w1", "w2", "copies")}
            for v, c1, c2, skip, context, copies in zip(*(batch.column(k).to_pylist() for k in ("v", "c1", "c2", "skip", "context", "copies")), strict=True):
                for s in range(len(context) - length + 1):
                    d = xxhash.xxh3_128_digest(context[s : s + length])
                    for k, x in zip(out, (v, c1, c2, skip, s, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), copies), strict=True):
                        out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k in ("skip", "start") else pa.int64()) for k, x in out.items()], list(out))

    windows = scratch.write(contexts.mapInArrow(make, "v long, c1 long, c2 long, skip int, start int, w1 long, w2 long, copies long"), "hot-windows")
    windows = windows.withColumn("off", F.col("skip") - F.col("start"))
    twice = windows.groupBy("v", "off", "w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    found = windows.join(scratch.write(twice, "hot-twice"), ["v", "off", "w1", "w2"])
    return found.groupBy("v", "c1", "c2", "skip").agg(F.min("start").alias("first"), F.max("start").alias("last"))


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Removes the spans: h1, h2, n_removed, n_spans, sha of what is left."""

    def make(batches):
        for batch in batches:
            removed, count, sha = [], [], []
            for raw, spans in zip(batch.column("raw"), batch.column("spans"), strict=True):
                raw = raw.as_py()
                pairs = sorted({(p + s["first"], p + s["last"] + length) for s in spans.as_py() for p in s["at"]})
                merged: list[list[int]] = []
                for a, b in pairs:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                removed.append(sum(b - a for a, b in merged))
                count.append(len(merged))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1"), batch.column("h2"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())],
                ["h1", "h2", "n_removed", "n_spans", "kept_sha256"],
            )

    return texts.mapInArrow(make, "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK, hot: int = HOT, doc_id: str = "doc_id", text: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per input row.

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere.

    1. Each text gives its anchors (see ``anchors``).  Equal texts form a class; the bytes
       of a class of several rows all go if there are ``length`` of them.
    2. Only anchors that two classes share, or that one text holds twice, can lie in a
       repeated string.  Their contexts, the strings that hold them, are the suffix
       buckets; equal contexts of a bucket are merged.
    3. Buckets with several contexts are suffix-sorted block by block (``sort_block``).
    4. The repeated starts give the spans that are cut from each text.

    Null text is empty.  Rows that repeat a doc_id are separate documents.
    """
    if not PERIOD <= length or not 0 < anchor <= length:
        raise ValueError(f"length must be {PERIOD} or more, and anchors at most as long")
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    t = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.cast("binary").alias("raw"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"))
    rows = scratch.write(_profiles(source, length, anchor), "profiles")
    classes = rows.groupBy("h1", "h2").agg(F.count("*").alias("rows"), F.min("doc_id").alias("rep"), F.first("n_bytes").alias("n_bytes"), F.first("once").alias("once"), F.first("more").alias("more"))
    classes = scratch.write(classes.where(F.col("n_bytes") >= length), "classes")
    both = F.concat(
        F.transform("once", lambda v: F.struct(v.alias("v"), F.lit(1).alias("n"))), F.transform("more", lambda v: F.struct(v.alias("v"), F.lit(2).alias("n")))
    )
    held = classes.select("h1", "h2", "rep", F.explode(both).alias("x")).select("h1", "h2", "rep", "x.v", "x.n")
    shared = scratch.write(held.groupBy("v").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("v").alias("w")), "shared")
    wanted = held.join(shared, held["v"] == shared["w"]).groupBy("h1", "h2", "rep").agg(F.collect_list("v").alias("values"))  # a text's own anchors
    wanted = scratch.write(wanted.withColumnsRenamed({"h1": "k1", "h2": "k2"}), "wanted")
    # one row of each class: with doc_id in the key, copies of one text don't meet
    able = source.join(wanted, (source["h1"] == wanted["k1"]) & (source["h2"] == wanted["k2"]) & source["doc_id"].eqNullSafe(wanted["rep"])).dropDuplicates(["h1", "h2"])
    able = scratch.write(able.select("h1", "h2", "raw", "values"), "able")

    occurs = scratch.write(_contexts(able, length, anchor), "occurrences")
    contexts = occurs.groupBy("v", "c1", "c2", "skip").agg(F.sum(F.size("at")).alias("copies"), F.first("context").alias("context"))
    contexts = scratch.write(contexts, "contexts")
    sizes = scratch.write(contexts.groupBy(F.col("v").alias("w")).agg(F.count("*").alias("m")), "sizes")
    sized = contexts.join(sizes, contexts["v"] == sizes["w"]).drop("w")
    alone = sized.where((F.col("m") == 1) & (F.col("copies") > 1))
    last = (F.length("context") - length).cast("int")
    found = alone.select("v", "c1", "c2", "skip", F.lit(0).alias("first"), last.alias("last"))
    found = found.union(_sorted_buckets(sized.where((F.col("m") > 1) & (F.col("m") <= hot)), length, block))
    crowd = sized.where(F.col("m") > hot)
    if not sizes.where(F.col("m") > hot).isEmpty():
        found = found.union(_hot_windows(crowd.drop("m"), scratch, length))
    found = scratch.write(found, "found")

    placed = occurs.select("h1", "h2", "v", "c1", "c2", "skip", "at").join(found, ["v", "c1", "c2", "skip"])
    spans = placed.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.collect_list(F.struct("at", "first", "last")).alias("spans"))  # of one text
    cut = _cut(able.drop("values").join(spans, (able["h1"] == spans["k1"]) & (able["h2"] == spans["k2"])).select("h1", "h2", "raw", "spans"), length)
    several = classes.where("rows > 1").select(
        "h1", "h2", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256")
    )
    cut = scratch.write(cut.join(several, ["h1", "h2"], "left_anti").union(several).withColumnsRenamed({"h1": "k1", "h2": "k2"}), "cut")
    out = rows.select("doc_id", "h1", "h2", "n_bytes", "sha").join(cut, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
