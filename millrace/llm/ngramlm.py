"""N-gram language model in an Elias-Fano trie of memory-mapped levels.

The trie has two levels, cut into shards by ranges of the first word's hash.  Level one
holds the words: their hashes as an Elias-Fano sequence (a word's id is its rank), exact
counts, and for each word a pointer to its successors and a backoff weight.  Level two
holds the successors' ids relative to their context, made one monotone sequence, and
quantised probabilities.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, set_aside
from .eliasfano import EliasFano

#: Absolute discount, and the least count of a stored pair unless the caller gives one.
DISCOUNT = 0.75
MIN_PAIR = 2
#: Quantised probabilities: LEVELS steps of equal log10 from FLOOR to 0.
LEVELS, FLOOR = 255, -8.0
SHARD_TOKENS = 2_000_000
CHUNK_TOKENS = 500_000
REMEMBER = 500_000
#: The token after the last word; it is also the context of the first.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))
_U = np.uint64
_SIGN = _U(1 << 63)
_STEPS = 10.0 ** (FLOOR * (1 - np.arange(LEVELS + 1) / LEVELS))


class Hasher:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, raw: bytes | None) -> np.ndarray:
        """Hashes of the tokens: lower-cased words, then the end."""
        words = (raw or b"").lower().split()
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens of each row, hashes of all)."""
    cut, parts, first, total = Hasher(), [], 0, 0
    for i, raw in enumerate(column.cast(pa.binary())):
        parts.append(cut(raw.as_py()))
        total += len(parts[-1])
        if total >= CHUNK_TOKENS:
            yield first, np.array([len(p) for p in parts]), np.concatenate(parts)
            parts, first, total = [], i + 1, 0
    if parts:
        yield first, np.array([len(p) for p in parts]), np.concatenate(parts)


def _contexts(lengths: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[np.cumsum(lengths) - lengths] = END
    return out


def _save(where: str, name: str, arrays: list[np.ndarray]) -> int:
    """Writes arrays as one file of 64-bit words behind a directory of offsets."""
    fs, root = pa.fs.FileSystem.from_uri(where)
    flat, places, at = [], [], 1 + 2 * len(arrays)
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8)
        words = np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]).view(np.uint64)
        places += [at, len(raw)]
        flat.append(words)
        at += len(words)
    body = np.concatenate([np.array([len(arrays), *places], np.uint64), *flat])
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(part) as f:
        f.write(body.tobytes())
    fs.move(part, f"{root}/{name}")  # a task that runs twice writes the same bytes
    return body.nbytes


def _load(where: str, name: str, types: str) -> list[np.ndarray]:
    """Memory-maps a file of ``_save``; one that isn't on a mounted disk is copied first."""
    fs, root = pa.fs.FileSystem.from_uri(where)
    path = f"{root}/{name}"
    if isinstance(fs, pa.fs.LocalFileSystem):
        words = np.asarray(np.memmap(path, np.uint64, "r"))
    else:
        with fs.open_input_stream(path) as f, tempfile.TemporaryFile() as copy:
            while block := f.read(1 << 24):
                copy.write(block)
            copy.flush()
            words = np.asarray(np.memmap(copy, np.uint64, "r"))
    n = int(words[0])
    out = []
    for k in range(n):
        at, size = int(words[1 + 2 * k]), int(words[2 + 2 * k])
        out.append(words[at : at - (-size // 8)].view(np.uint8)[:size].view({"q": np.uint64, "b": np.uint8, "h": np.uint16}[types[k]]))
    return out


class Trie:
    """The levels of a model, opened shard by shard as they are asked for."""

    def __init__(self, where: str, bits: int, offsets: list[int], words: int, tokens: int):
        self.where, self.bits, self.offsets, self.words, self.tokens = where, bits, np.array(offsets, np.int64), words, tokens
        self.one, self.two = {}, {}

    def __reduce__(self):
        return Trie, (self.where, self.bits, self.offsets.tolist(), self.words, self.tokens)

    def shard_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def level_one(self, s: int):
        if s not in self.one:
            a = _load(self.where, f"one-{s}", "qqqqq")
            self.one[s] = EliasFano.of(a[:4]), a[4]
        return self.one[s]

    def level_two(self, s: int):
        if s not in self.two:
            a = _load(self.where, f"two-{s}", "qqqqqqqqbh")
            self.two[s] = EliasFano.of(a[:4]), EliasFano.of(a[4:8]), a[8], a[9]
        return self.two[s]

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each hash; id -1 and count 0 where it is unknown."""
        ids, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        mask = _U((1 << (64 - self.bits)) - 1)
        for s, at in _by(self.shard_of(h)):
            if self.offsets[s + 1] > self.offsets[s]:
                seq, counts = self.level_one(s)
                r = seq.find(h[at] & mask)
                ok = r >= 0
                ids[at[ok]] = r[ok] + self.offsets[s]
                count[at[ok]] = counts[r[ok]]
        return ids, count

    def successors(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first, last + 1, value before, backoff) of each context in its shard's level two."""
        lo, hi, base, back = (np.zeros(len(ids), t) for t in (np.int64, np.int64, np.uint64, float))
        back[:] = 1.0
        known = np.flatnonzero(ids >= 0)
        shard = np.searchsorted(self.offsets, ids[known], "right") - 1
        for s, k in _by(shard):
            at = known[k]
            ptr, seq, _, weight = self.level_two(s)
            r = ids[at] - self.offsets[s]
            lo[at], hi[at] = ptr.get(r).astype(np.int64), ptr.get(r + 1).astype(np.int64)
            back[at] = weight[r] / 65535.0
            some = at[lo[at] > 0]
            base[some] = seq.get(lo[some] - 1)
        return lo, hi, base, back

    def pair(self, shard: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Discounted probability of each (context, word); 0 where the pair isn't stored."""
        out = np.zeros(len(lo))
        ask = np.flatnonzero((hi > lo) & (word >= 0))
        for s, k in _by(shard[ask]):
            at = ask[k]
            _, seq, code, _ = self.level_two(s)
            i = seq.find(base[at] + word[at].astype(np.uint64) + _U(1))
            ok = (i >= lo[at]) & (i < hi[at])
            out[at[ok]] = _STEPS[code[i[ok]]]
        return out


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, positions) of equal keys."""
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(keys[part[0]]), part


def _count_words(docs: DataFrame) -> DataFrame:
    def count(batches):
        for batch in batches:
            found = [np.unique(h, return_counts=True) for _, _, h in _chunks(batch.column(0))]
            if found:
                h, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([f[1] for f in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((h ^ _SIGN).view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _write_level_one(words: DataFrame, where: str, bits: int) -> DataFrame:
    """Words sorted by hash within their shard -> files; (shard, words)."""

    def put(s, h, n):
        seq = EliasFano.build(h & _U((1 << (64 - bits)) - 1), 1 << (64 - bits))
        _save(where, f"one-{s}", [*seq.parts(), n.astype(np.uint64)])

    def write(batches):
        shard, hs, ns, out = None, [], [], []
        for batch in batches:
            s, h, n = (batch.column(k).to_numpy() for k in ("shard", "h", "n"))
            for key, at in _by(s):
                if shard is not None and key != shard:
                    put(shard, np.concatenate(hs), np.concatenate(ns))
                    out.append((shard, sum(map(len, hs))))
                    hs, ns = [], []
                shard = key
                hs.append(h[at].view(np.uint64) ^ _SIGN)
                ns.append(n[at])
        if shard is not None:
            put(shard, np.concatenate(hs), np.concatenate(ns))
            out.append((shard, sum(map(len, hs))))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["shard", "words"])

    keyed = words.withColumn("shard", F.shiftright(F.col("h"), 64 - bits) + (1 << (bits - 1)))
    return keyed.repartition("shard").sortWithinPartitions("shard", "h").mapInArrow(write, "shard long, words long")


def _pairs(docs: DataFrame, bits: int) -> DataFrame:
    """Counts of pairs in a batch, packed by the context's shard."""

    def pack(batches):
        for batch in batches:
            found = []
            for _, lengths, h in _chunks(batch.column(0)):
                order = np.lexsort((h, c := _contexts(lengths, h)))
                a, b = c[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                found.append((a[first], b[first], np.diff(np.append(first, len(a))).astype(np.uint32)))
            if not found:
                continue
            a, b, n = (np.concatenate([f[k] for f in found]) for k in range(3))
            shards, blobs = [], []
            for s, at in _by((a >> _U(64 - bits)).astype(np.int64)):
                a_s, b_s, n_s = _merge(a[at], b[at], n[at])
                first = np.flatnonzero(np.concatenate([[True], a_s[1:] != a_s[:-1]]))
                run = np.diff(np.append(first, len(a_s))).astype(np.uint32)
                head = np.array([len(first), len(a_s)], np.uint64)
                # hashes of successors are cut to 48 bits, counts of one to no byte at all
                more = np.flatnonzero(n_s > 1).astype(np.uint32)
                low = (b_s >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                blobs.append(b"".join(x.tobytes() for x in (head, a_s[first], run, np.array([len(more)], np.uint32), more, n_s[more].astype(np.uint32), np.ascontiguousarray(low))))
                shards.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    return docs.mapInArrow(pack, "shard long, blob binary")


def _merge(a, b, n):
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n[:0]


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, pairs = (int(x) for x in np.frombuffer(blob, np.uint64, 2))
    at = 16
    a = np.frombuffer(blob, np.uint64, contexts, at)
    at += 8 * contexts
    run = np.frombuffer(blob, np.uint32, contexts, at)
    at += 4 * contexts
    m = int(np.frombuffer(blob, np.uint32, 1, at)[0])
    more, counts = np.frombuffer(blob, np.uint32, m, at + 4), np.frombuffer(blob, np.uint32, m, at + 4 + 4 * m)
    at += 4 + 8 * m
    n = np.ones(pairs, np.int64)
    n[more] = counts
    low = np.zeros((pairs, 8), np.uint8)
    low[:, :6] = np.frombuffer(blob, np.uint8, 6 * pairs, at).reshape(-1, 6)
    return np.repeat(a, run), low.view("<u8").ravel(), n


def _write_level_two(pairs: DataFrame, model: Trie, shared, min_pair: int) -> DataFrame:
    """Packed pairs -> files; (shard, pairs, bytes).  Every shard of level one gets one."""

    def put(trie: Trie, s: int, blobs: list[bytes], tops: np.ndarray):
        size = int(trie.offsets[s + 1] - trie.offsets[s])
        a, b, n = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True)) if blobs else (np.zeros(0, np.uint64),) * 3
        a, b, n = _merge(a, b, n)
        keep = n >= min_pair
        a, b, n = a[keep], b[keep], n[keep]
        ids, count = trie.lookup(a)
        rank = ids - trie.offsets[s]
        word = tops[1][np.searchsorted(tops[0], b)] if len(b) else np.zeros(0, np.int64)
        order = np.lexsort((word, rank))
        rank, word, n, count = rank[order], word[order], n[order], count[order]
        first = np.bincount(rank, minlength=size)
        ends = np.cumsum(np.append(0, first))
        code = np.clip(np.floor((np.log10((n - DISCOUNT) / np.maximum(count, 1)) / -FLOOR + 1) * LEVELS + 1e-9), 0, LEVELS).astype(np.uint8)
        mass = np.bincount(rank, _STEPS[code], minlength=size) if len(rank) else np.zeros(size)
        back = np.floor(np.clip(1 - mass, 0, 1) * 65535).astype(np.uint16)
        # each context's ids start where the last one's ended, so the level is monotone
        last = np.zeros(size, np.int64)
        some = np.flatnonzero(first)
        last[some] = word[ends[some + 1] - 1] + 1
        before = np.cumsum(last) - last
        z = (before[rank] + word + 1).astype(np.uint64) if len(rank) else np.zeros(0, np.uint64)
        ptr = EliasFano.build(ends.astype(np.uint64), len(rank) + 1)
        seq = EliasFano.build(z, int(last.sum()) + 2)
        return len(rank), _save(trie.where, f"two-{s}", [*ptr.parts(), *seq.parts(), code, back])

    def write(batches):
        trie: Trie = shared.value
        shard, blobs, out = None, [], []

        def flush():
            if shard is not None:
                cut = [x for x in blobs if x]
                b = np.unique(np.concatenate([_unpack(x)[1] for x in cut])) if cut else np.zeros(0, np.uint64)
                out.append((shard, *put(trie, shard, cut, _resolve(trie, b))))

        for batch in batches:
            for s, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if s != shard:
                    flush()
                    shard, blobs = s, []
                blobs.append(blob)
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["shard", "pairs", "bytes"])

    spark = pairs.sparkSession
    every = spark.range(1 << model.bits).select(F.col("id").alias("shard"), F.lit(b"").alias("blob"))
    every = every.where(F.col("shard").isin([int(s) for s in np.flatnonzero(np.diff(model.offsets))]))
    return pairs.union(every).repartition("shard").sortWithinPartitions("shard").mapInArrow(write, "shard long, pairs long, bytes long")


def _resolve(trie: Trie, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes cut to 48 bits, ids): the words of those hashes, by successor search.

    The first word whose hash is not below the cut one is the word, since all are known.
    """
    ids = np.full(len(cut), -1, np.int64)
    x = cut << _U(16)
    mask = _U((1 << (64 - trie.bits)) - 1)
    for s, at in _by(trie.shard_of(x)):
        seq, _ = trie.level_one(s)
        every = seq.get(np.arange(seq.n))
        ids[at] = np.minimum(np.searchsorted(every, x[at] & mask), seq.n - 1) + trie.offsets[s]
    return cut, ids


def train(docs: DataFrame, text: str = "text", shard_tokens: int = SHARD_TOKENS, scratch: Scratch | None = None, min_pair: int = MIN_PAIR) -> Trie:
    """Counts all tokens and pairs of ``docs`` and writes the trie to the shared folder.

    Pairs seen less than ``min_pair`` times are not stored; 1 stores all.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    texts = docs.select(F.col(text).alias("text"))
    words = scratch.write(_count_words(texts), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    bits = max(2, (total["n"] // shard_tokens).bit_length())
    where = scratch.path("trie")
    sizes = {r[0]: r[1] for r in _write_level_one(words, where, bits).collect()}  # a row a shard
    offsets = [0, *np.cumsum([sizes.get(s, 0) for s in range(1 << bits)]).tolist()]
    model = Trie(where, bits, offsets, total["v"], total["n"])
    shared = spark.sparkContext.broadcast(model)  # paths and shard sizes, no counts
    _write_level_two(_pairs(texts, bits), model, shared, min_pair).agg(F.sum("bytes")).collect()
    return model


def score(docs: DataFrame, model: Trie, text: str = "text") -> DataFrame:
    """The input rows with n_tokens, n_known, train_tokens, base_score, lm_score (log10).

    Null text is empty: one token, the end.  Columns of those names in the input are kept
    under the names of ``set_aside``.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "lm_score"]
    work = docs.withColumnsRenamed(set_aside(docs, new))
    at = work.columns.index(text)
    zero = F.lit(0).cast("long")
    schema = work.select("*", *(zero.alias(c) for c in new[:3]), *(F.lit(0.0).alias(c) for c in new[3:])).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trie: Trie = shared.value
        room = trie.tokens + 0.5 * (trie.words + 1)
        for batch in batches:
            n_tokens, n_known, base, full = [], [], [], []
            for _, lengths, h in _chunks(batch.column(at)):
                own, where = np.unique(h, return_inverse=True)
                ids, count = trie.lookup(own)
                p = (count + 0.5) / room
                end = int(np.searchsorted(own, END))
                lo, hi, before, back = trie.successors(ids)
                shard = trie.shard_of(own)
                context = np.empty_like(where)
                context[1:] = where[:-1]
                starts = np.cumsum(lengths) - lengths
                context[starts] = end
                pair = trie.pair(shard[context], lo[context], hi[context], before[context], ids[where])
                prob = np.log10(pair + back[context] * p[where])
                n_tokens += lengths.tolist()
                n_known += np.add.reduceat((count > 0)[where].astype(np.int64), starts).tolist()
                base += np.add.reduceat(np.log10(p)[where], starts).tolist()
                full += np.add.reduceat(prob, starts).tolist()
            n = len(n_tokens)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([trie.tokens] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())],
                [*batch.schema.names, *new],
            )

    return work.mapInArrow(run, schema)
