"""Importance resampling towards a target: hashed n-gram features in two Arrow passes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, Scratch, set_aside

BUCKETS = 10_000
#: Bytes of text whose features are held at a time.
CHUNK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 256
#: Columns that ``importance`` and ``draw`` add.
NEW, DRAWN = ("n_words", "n_features", "weight"), ("score", "rank")
_U32 = np.uint32


def _byte_step() -> np.ndarray:
    t = np.arange(256, dtype=_U32)
    for _ in range(8):
        t = np.where(t & _U32(1), (t >> _U32(1)) ^ _U32(0xEDB88320), t >> _U32(1))
    return t


#: The crc register after one byte; ``SHIFT[n, k, b]``: byte k of a register, b, after n zero bytes.
STEP = _byte_step()
SHIFT = np.empty((LONG + 2, 4, 256), _U32)
SHIFT[0] = np.arange(256, dtype=_U32)[None, :] << (_U32(8) * np.arange(4, dtype=_U32))[:, None]
for _n in range(LONG + 1):
    SHIFT[_n + 1] = (SHIFT[_n] >> _U32(8)) ^ STEP[SHIFT[_n] & _U32(255)]


def _shift(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after ``n`` zero bytes each."""
    long = np.flatnonzero(n > LONG + 1)
    m = np.minimum(n, LONG + 1)
    out = SHIFT[m, 0, state & _U32(255)]
    for k in range(1, 4):
        out ^= SHIFT[m, k, (state >> _U32(8 * k)) & _U32(255)]
    for i in long:
        rest = int(n[i]) - LONG - 1  # zlib goes on from a register as it does from bytes
        out[i] = zlib.crc32(bytes(rest), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def _registers(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The register of each word's bytes, from zero."""
    out = np.zeros(len(start), _U32)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    at, left = start[order], size[order]
    whole = int(np.searchsorted(-left, -LONG))  # words before this are long
    for i in range(whole):
        word = data[at[i] : at[i] + left[i]].tobytes()
        out[order[i]] = zlib.crc32(word, 0xFFFFFFFF) ^ 0xFFFFFFFF
    at, left, order = at[whole:], left[whole:], order[whole:]
    state = np.zeros(len(at), _U32)
    for k in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -k))  # words of more than k bytes
        s = state[:m]
        state[:m] = (s >> _U32(8)) ^ STEP[(s ^ data[at[:m] + k]) & _U32(255)]
    out[order] = state
    return out


def _features(data: np.ndarray, first: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket, text) of the 1- to 3-grams of lowered bytes.

    ``first`` has the start of each text.  Where ``skip`` is above zero, the piece belongs to one
    text and begins with ``skip`` words counted before: only n-grams that end behind them count.
    """
    gap = data == 0x20
    cut = np.concatenate([[True], gap[:-1]])
    cut[first[first < len(data)]] = True
    start = np.flatnonzero(cut & ~gap)
    last = np.concatenate([gap[1:], [True]])
    inner = first[(first > 0) & (first <= len(data))] - 1
    last[inner] = True
    size = np.flatnonzero(last & ~gap) - start + 1
    text = np.searchsorted(first, start, "right") - 1
    own = _registers(data, start, size)
    ahead = _shift(np.full(len(own), STEP[0x20], _U32), size) ^ own  # of a space and the word
    state = _shift(np.full(len(own), 0xFFFFFFFF, _U32), size) ^ own
    buckets, texts = [], []
    for n in range(3):
        if n:
            state = _shift(state[:-1], size[n:] + 1) ^ ahead[n:]
        count = np.arange(len(state)) + n >= skip
        count &= text[: len(state)] == text[n:]
        buckets.append((~state[count] % _U32(BUCKETS)).astype(np.int64))
        texts.append(text[: len(state)][count])
        if len(state) < 2:
            break
    words = np.bincount(text[skip:], minlength=len(first))
    return words, np.concatenate(buckets), np.concatenate(texts)


def _pieces(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in pieces that end between words, each after the last two words before it."""
    at, tail, skip = 0, b"", 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and (gap := data[at:end].translate(WORD_BYTES).rfind(b" ")) < 0:
            end += CHUNK
        end = len(data) if end >= len(data) else at + gap + 1
        low = tail + data[at:end].translate(WORD_BYTES)
        yield np.frombuffer(low, np.uint8), skip
        words = low.rsplit(maxsplit=2)[-2:] if low.strip() else []
        tail, skip, at = b" ".join([*words, b""]), len(words), end


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, words, bucket, text) of runs of successive texts; a text of over CHUNK bytes
    comes alone, in pieces.  Null texts have no words."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")
    k = 0
    while k < len(texts):
        upto = max(k + 1, int(np.searchsorted(ends, ends[k] + CHUNK, "right")) - 1)
        data = bytes(raw[ends[k] : ends[upto]])
        if len(data) > CHUNK:
            for piece, skip in _pieces(data):
                yield k, *_features(piece, np.zeros(1, np.int64), skip)
        elif data:
            yield k, *_features(np.frombuffer(data.translate(WORD_BYTES), np.uint8), ends[k:upto] - ends[k], 0)
        k = upto


def bucket_counts(docs: DataFrame, text: str = "text", depth: int = 3) -> np.ndarray:
    """How many features of all whole texts fall in each bucket.

    A partition counts into one vector of BUCKETS longs and sends it as one row; vectors merge
    on the executors by ``treeReduce``, so the driver gets some (partitions ** (1 / depth)).
    """

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, bucket, _ in text_features(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(text).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = docs.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1)  # an empty table may have no partition
    return vectors.union(none).treeReduce(np.add, depth)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's smoothed share in the target over that in the corpus."""
    s, t = float(raw.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((y + 1.0) * s / ((x + 1.0) * t))) for x, y in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def importance(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> DataFrame:
    """The input rows with n_words, n_features and weight, the sum of the gains of a text's features.

    Features are all runs of one to three words.  Null texts and texts without words have
    none and weight 0; an empty target gives uniform counts; an empty table gives an empty result.
    Columns called like a new one are kept under the names of ``set_aside``.
    """
    work = docs.withColumnsRenamed(set_aside(docs, NEW))
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, text), bucket_counts(target, target_text)).astype(float))
    at = docs.columns.index(text)
    schema = work.select("*", *(F.lit(0).cast("long").alias(c) for c in NEW)).schema

    def weigh(batches):
        for batch in batches:
            words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for k, counts, bucket, text_no in text_features(batch.column(at)):
                words[k : k + len(counts)] += counts
                weight[k : k + len(counts)] += np.bincount(text_no, weights=gain.value[bucket], minlength=len(counts))
            features = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            new = [pa.array(x, pa.int64()) for x in (words, features, weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *NEW])

    return work.mapInArrow(weigh, schema)


def draw(weighted: DataFrame, seed: int = 42, percent: int = 5, min_words: int = 20, doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``importance`` with score and rank: weight plus Gumbel noise by the id.

    Of the texts of at least ``min_words`` words, ``percent`` per cent with the highest scores are
    drawn and get ranks from 1, ties to the smaller id, a null id (which draws like an empty
    one) before all; the others' rank is null.  Rows that agree in both are told apart by where they
    lie, so no group of them is one task's.  Rows are dealt by range, sorted within
    partitions and counted; what is not carried into ``weighted`` isn't shuffled.  Columns
    called like a new one are kept under the names of ``set_aside``.
    """
    spark = weighted.sparkSession
    aside = set_aside(weighted, DRAWN)
    weighted, doc_id = weighted.withColumnsRenamed(aside), aside.get(doc_id, doc_id)
    scratch = scratch or Scratch(spark, "importance")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    held = weighted.select(
        F.struct(*(F.col(f"`{c}`") for c in weighted.columns)).alias("held"), F.col(f"`{doc_id}`").alias("id"), (F.col("weight") + noise).cast("long").alias("score"),
        (F.col("n_words") >= min_words).alias("fit"), F.monotonically_increasing_id().alias("at"),
    )
    rows = scratch.write(held, "scores")
    drawn = rows.where("fit").count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("at")]
    ordered = scratch.write(
        rows.where("fit").repartitionByRange(*order).sortWithinPartitions(*order).select("held", "score", F.monotonically_increasing_id().alias("place")), "ordered"
    )
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("part", F.coalesce(before, F.lit(0)).alias("start")))
    ranked = ordered.join(starts, part == F.col("part")).withColumn("rank", F.col("start") + within + 1)
    ranked = ranked.select("held", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(rows.where("not fit").select("held", "score", F.lit(None).cast("long").alias("rank"))).select("held.*", "score", "rank")
