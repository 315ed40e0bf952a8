"""Benchmark decontamination by a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, set_aside, words_of

WINDOW = 13
SHINGLE = 3
#: Benchmark words in one broadcast block; a larger benchmark is taken block by block.
BLOCK_WORDS = 2_000_000
#: Words of documents handled at once in a task.
CHUNK_WORDS = 400_000
#: Columns that ``find_contamination`` adds, and those it uses on the way.
NEW = ("n_words", "n_hit", "n_items", "items", "spans", "_spans", "_items", "_n")


class Windows:
    """The windows of one block of benchmark items, as word ids, with their shingles."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, shingle: int):
        self.ids: dict[bytes, int] = {}
        grouped: dict[int, dict[tuple, set]] = {}
        for item, words in items:
            ids = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words)
            n = min(window, len(ids))
            for s in range(len(ids) - n + 1 if n else 0):
                grouped.setdefault(n, {}).setdefault(ids[s : s + n], set()).add(item)
        self.base = len(self.ids) + 1
        self.shingle = shingle
        #: length -> (windows as a matrix, the items of each)
        self.by_length = {
            n: (np.array(list(g), np.int64).reshape(-1, n), [sorted(v) for v in g.values()]) for n, g in grouped.items()
        }

    def width(self, n: int) -> int:
        width = min(self.shingle, n)
        while self.base**width >= 2**62:  # codes are 64-bit
            width -= 1
        return width

    def codes(self, ids: np.ndarray, width: int) -> np.ndarray:
        """Code of the shingle that starts at each position; 0 where an unknown word is in it."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(width):
            part = ids[k : k + n]
            out = out * self.base + part
            ok &= part > 0
        return np.where(ok, out, 0)

    def shingle_codes(self) -> dict[int, np.ndarray]:
        """width -> sorted distinct codes of the windows."""
        found: dict[int, list] = {}
        for n, (m, _) in self.by_length.items():
            w = self.width(n)
            found.setdefault(w, []).append(np.concatenate([self.codes_of(m, w, o) for o in range(n - w + 1)]))
        return {w: np.unique(np.concatenate(x)) for w, x in found.items()}

    def codes_of(self, m: np.ndarray, width: int, at: int) -> np.ndarray:
        out = np.zeros(len(m), np.int64)
        for k in range(width):
            out = out * self.base + m[:, at + k]
        return out

    def index(self, df: dict[tuple[int, int], int]) -> None:
        """Orders the shingles of each window by rarity and keeps its prefix.

        A window occurs only where all its shingles do, so the prefix that must be joined
        is its first shingle in that order.  df: documents that hold (width, code).
        """
        self.prefix = {}
        for n, (m, _) in self.by_length.items():
            w = self.width(n)
            all_codes = np.stack([self.codes_of(m, w, o) for o in range(n - w + 1)], axis=1)
            known, where = np.unique(all_codes, return_inverse=True)
            count = np.array([df.get((w, int(c)), 0) for c in known])[where.reshape(all_codes.shape)]
            best = np.lexsort((all_codes, count), axis=1)[:, 0] if n - w + 1 > 1 else np.zeros(len(m), int)
            rarest = all_codes[np.arange(len(m)), best]
            order = np.argsort(rarest, kind="stable")
            self.prefix[n] = (rarest[order], best[order], order)

    def find(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, start, window number) of every occurrence in the joined word ids.

        ``ends``: for each position, the end of its document (positional bound).
        """
        for n, (m, _) in self.by_length.items():
            w = self.width(n)
            rarest, offset, number = self.prefix[n]
            here = self.codes(ids, w)
            at = np.flatnonzero(here)
            at = at[np.isin(here[at], rarest)]
            lo, hi = np.searchsorted(rarest, here[at], "left"), np.searchsorted(rarest, here[at], "right")
            most = 1_000_000  # candidate pairs verified at once
            upto = np.cumsum(hi - lo)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
                reps = (hi - lo)[a:b]
                pos = np.repeat(at[a:b], reps)
                pick = np.repeat(lo[a:b], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                start = pos - offset[pick]
                ok = (start >= 0) & (start + n <= ends[pos])
                start, win = start[ok], number[pick[ok]]
                for k in range(n):  # exact containment, word by word
                    same = ids[start + k] == m[win, k]
                    start, win = start[same], win[same]
                if len(start):
                    yield n, start, win
                a = b


def _chunks(texts: pa.Array, ids: dict[bytes, int]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(first row, words of each row, word ids with a 0 after each row)."""
    first, lengths, parts, total = 0, [], [], 0
    get = ids.get
    for i, raw in enumerate(texts.cast(pa.binary())):
        words = words_of(raw.as_py() or b"")
        part = np.zeros(len(words) + 1, np.int64)
        part[:-1] = [get(w, 0) for w in words]
        lengths.append(len(words))
        parts.append(part)
        total += len(words)
        if total >= CHUNK_WORDS:
            yield first, lengths, np.concatenate(parts)
            first, lengths, parts, total = i + 1, [], [], 0
    if lengths:
        yield first, lengths, np.concatenate(parts)


def _frequency(docs: DataFrame, windows, text: str) -> dict[tuple[int, int], int]:
    """Documents that hold each benchmark shingle, over all documents."""

    def count(batches):
        win: Windows = windows.value
        codes = win.shingle_codes()
        seen = {w: np.zeros(len(c), np.int64) for w, c in codes.items()}
        for batch in batches:
            for _, lengths, ids in _chunks(batch.column(0), win.ids):
                row = np.repeat(np.arange(len(lengths)), np.array(lengths) + 1)
                for w, c in codes.items():
                    here = win.codes(ids, w)
                    at = np.flatnonzero(here)
                    k = np.searchsorted(c, here[at])
                    hit = (k < len(c)) & (c[np.minimum(k, len(c) - 1)] == here[at])
                    pairs = np.unique(row[at[hit]] * np.int64(len(c)) + k[hit])
                    np.add.at(seen[w], pairs % len(c), 1)
        for w, c in codes.items():
            some = seen[w] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(some.sum(), w, np.int64)), pa.array(c[some]), pa.array(seen[w][some])], ["width", "code", "n"]
            )

    found = docs.select(text).mapInArrow(count, "width long, code long, n long").groupBy("width", "code").agg(F.sum("n").alias("n"))
    return {(r[0], r[1]): r[2] for r in found.collect()}  # at most the shingles of one block


def _item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, words = [], 0
    for row in items.toLocalIterator(prefetchPartitions=False):
        w = words_of((row[1] or "").encode())
        if row[0] is None or not w:
            continue
        block.append((str(row[0]), w))
        words += len(w)
        if words >= block_words:
            yield block
            block, words = [], 0
    yield block


def _mark(docs: DataFrame, windows, text: str) -> DataFrame:
    """Adds this block's hits to the columns ``_spans`` (merged, word positions) and ``_items``."""
    schema = T.StructType(docs.schema.fields[:])

    def mark(batches):
        win: Windows = windows.value
        for batch in batches:
            spans, items = batch.column(batch.schema.get_field_index("_spans")).to_pylist(), batch.column(batch.schema.get_field_index("_items")).to_pylist()
            n_words = batch.column(batch.schema.get_field_index("_n")).to_pylist()
            for first, lengths, ids in _chunks(batch.column(batch.schema.get_field_index(text)), win.ids):
                sizes = np.array(lengths) + 1
                ends = np.cumsum(sizes) - 1
                begins = ends - sizes + 1
                row = np.repeat(np.arange(len(lengths)), sizes)
                found: dict[int, list] = {}
                for n, start, number in win.find(ids, ends[row]):
                    owner = win.by_length[n][1]
                    for s, k in zip(start.tolist(), number.tolist(), strict=True):
                        found.setdefault(int(row[s]), []).append((s, n, owner[k]))
                for i, x in enumerate(lengths):
                    n_words[first + i] = x
                for i, hits in found.items():
                    own, at = set(items[first + i]), int(begins[i])
                    pieces = [tuple(p) for p in zip(spans[first + i][::2], spans[first + i][1::2], strict=True)]
                    for s, n, owner in hits:
                        own.update(owner)
                        pieces.append((s - at, s - at + n))
                    merged: list[int] = []
                    for a, b in sorted(pieces):
                        if merged and a <= merged[-1]:
                            merged[-1] = max(merged[-1], b)
                        else:
                            merged += [a, b]
                    spans[first + i], items[first + i] = merged, sorted(own)
            columns = [
                pa.array({"_spans": spans, "_items": items, "_n": n_words}[f.name], f.type) if f.name in ("_spans", "_items", "_n") else batch.column(k)
                for k, f in enumerate(batch.schema)
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mark, schema)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, scratch: Scratch | None = None,
) -> DataFrame:
    """The input rows with n_words, n_hit, n_items, items (sorted), spans (start, end, ...).

    Columns of those names that the input has are kept under the names of ``set_aside``.
    Null text has no words; items without an id or without words are skipped; repeated items count once.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    spark = docs.sparkSession
    work = docs.withColumnsRenamed(set_aside(docs, NEW))
    plain = work
    work = work.select(
        "*", F.array().cast("array<int>").alias("_spans"), F.array().cast("array<string>").alias("_items"), F.lit(0).alias("_n")
    )
    blocks = _item_blocks(benchmark.select(item_id, item_text), block_words)
    block, last = next(blocks), None
    while block is not None:
        following = next(blocks, None)
        win = Windows(block, window, shingle)
        shared = spark.sparkContext.broadcast(win)
        win.index(_frequency(plain, shared, text) if win.by_length else {})
        work = _mark(work, spark.sparkContext.broadcast(win), text)
        if following is not None:  # the next block's pass starts from a table
            table = scratch.write(work, "block")
            if last is not None:
                scratch.drop(last)
            work = last = table
        block = following
    signed = F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    hit = F.aggregate(signed, F.lit(0), lambda n, x: n + x)
    return work.select(
        *(F.col(c) for c in plain.columns), F.col("_n").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), F.col("_spans").alias("spans"),
    )


def contaminated():
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def items_digest():
    return F.sha2(F.array_join("items", ","), 256)


NO_ITEMS = hashlib.sha256(b"").hexdigest()
