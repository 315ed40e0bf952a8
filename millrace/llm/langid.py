"""Language identification with a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import set_aside

#: Feature space and bounds of the fit; prediction has no bound.
BUCKETS = 1 << 16
MAX_FIT_DOCS = 3000
MAX_FIT_WORDS = 300_000
MAX_FIT_CHARS = 2_000
EPOCHS = 6
#: Words labelled at once in a task, and words remembered with their emission scores.
CHUNK_WORDS = 200_000
REMEMBER = 400_000
#: New words whose features are held at once: a word has some thirty, each a row of weights.
FRESH = 4_000
#: Columns that ``identify`` adds.
NEW = ("lang_pred", "score", "word_counts")
#: A word is a run of letters.
LETTERS = re.compile(r"[^\W\d_]+")


_BUCKET: dict[str, int] = {}


def _bucket(feature: str) -> int:
    i = _BUCKET.get(feature)
    if i is None:
        if len(_BUCKET) > REMEMBER:
            _BUCKET.clear()
        i = _BUCKET[feature] = zlib.crc32(feature.encode()) % BUCKETS
    return i


def features(word: str) -> list[int]:
    """Hashed features: the word (lexicon entry), affixes of 2 to 4 and n-grams of 1 to 3."""
    framed = f"^{word}$"
    out = set(word)
    out.update(map("".join, zip(framed, framed[1:], strict=False)))
    out.update(map("".join, zip(framed, framed[1:], framed[2:], strict=False)))
    for k in (2, 3, 4):
        if len(word) >= k:
            out.add(f"{word[:k]}-")
            out.add(f"-{word[-k:]}")
    return [zlib.crc32(word.encode(), 1) % BUCKETS, *sorted(map(_bucket, out))]


class Model:
    """labels, emission weights (BUCKETS, K) and transition weights (K, K)."""

    def __init__(self, labels: list[str], emit: np.ndarray, trans: np.ndarray):
        self.labels, self.emit, self.trans = labels, emit.astype(np.float32), trans.astype(np.float32)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(labels)), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Row of ``rows`` for each word; a word's scores are computed once."""
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        fresh = list(set(words).difference(known))
        if fresh:
            start = len(known)
            known.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            while len(known) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for at in range(0, len(fresh), FRESH):
                cells = [features(w) for w in fresh[at : at + FRESH]]
                n = np.array([len(c) for c in cells])
                flat = np.fromiter((x for c in cells for x in c), np.int64, int(n.sum()))
                self.rows[start + at : start + at + len(cells)] = np.add.reduceat(self.emit[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def messages(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Node and edge potentials, forward and backward messages (rescaled at each word).

        ``scores``: emissions of all sequences, one after another.  The sequences advance
        together, longest first, so step t works on all that have a word t.
        """
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right").tolist() if len(sizes) else []
        phi = np.exp(scores - scores.max(axis=1, keepdims=True))
        psi = np.exp(self.trans - self.trans.max())
        fore, back = np.empty_like(phi), np.ones_like(phi)
        for t, k in enumerate(active):
            at = starts[:k] + t
            a = phi[at] if t == 0 else (fore[at - 1] @ psi) * phi[at]
            fore[at] = a / a.sum(axis=1, keepdims=True)
        for t in range(len(active) - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            b = (back[at + 1] * phi[at + 1]) @ psi.T
            back[at] = b / b.sum(axis=1, keepdims=True)
        return phi, psi, fore, back

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Posterior of each label at each word."""
        _, _, fore, back = self.messages(scores, lengths)
        out = fore * back
        return out / out.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7, max_words: int = MAX_FIT_WORDS) -> Model:
    """Maximum likelihood by AdaGrad on code-switched sequences of (text, lang) rows.

    A row's words all carry its language.  Transitions are learned on sequences that join
    passages of several rows, as switched text does.
    """
    labels = sorted({lang for _, lang in rows})
    k = max(1, len(labels))
    rng = np.random.default_rng(seed)
    pieces = []
    for text, lang in rows:
        words = LETTERS.findall(text.lower())
        at = 0
        while at < len(words):
            n = int(rng.integers(5, 40))
            pieces.append((labels.index(lang), words[at : at + n]))
            at += n
    rng.shuffle(pieces)
    kept, total = [], 0
    for p in pieces:  # a random sample of passages, bounded in words
        kept.append(p)
        total += len(p[1])
        if total >= max_words:
            break
    vocab: dict[str, int] = {}
    feats: list[list[int]] = []
    for _, ws in kept:
        for w in ws:
            if w not in vocab:
                vocab[w] = len(vocab)
                feats.append(features(w))
    width = max((len(f) for f in feats), default=1)
    table = np.full((len(feats), width), BUCKETS, np.int64)
    scale = np.zeros((len(feats), 1), np.float32)
    for i, f in enumerate(feats):
        table[i, : len(f)], scale[i] = f, 1 / np.sqrt(len(f))
    emit, g_emit = np.zeros((BUCKETS + 1, k), np.float32), np.full((BUCKETS + 1, k), 1e-2, np.float32)
    trans, g_trans = np.zeros((k, k), np.float32), np.full((k, k), 1e-2, np.float32)
    sequences = [kept[i : i + 4] for i in range(0, len(kept), 4)]
    model = Model(labels, emit, trans)
    for _ in range(epochs if k > 1 else 0):
        rng.shuffle(sequences)
        for b in range(0, len(sequences), 64):
            batch = sequences[b : b + 64]
            ids = np.array([vocab[w] for s in batch for _, ws in s for w in ws])
            gold = np.array([y for s in batch for y, ws in s for _ in ws])
            lengths = np.array([sum(len(ws) for _, ws in s) for s in batch])
            cells = table[ids]
            scores = emit[cells].sum(axis=1) * scale[ids]
            model.trans = trans
            phi, psi, fore, back = model.messages(scores, lengths)
            grad = fore * back
            grad /= grad.sum(axis=1, keepdims=True)
            first = np.zeros(len(ids), bool)
            first[np.cumsum(lengths) - lengths] = True
            inner = np.flatnonzero(~first)
            pair = fore[inner - 1][:, :, None] * psi[None] * (phi[inner] * back[inner])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            d_trans = pair.sum(axis=0)  # expected less observed transitions
            np.add.at(d_trans, (gold[inner - 1], gold[inner]), -1)
            grad[np.arange(len(ids)), gold] -= 1
            d_emit = np.zeros_like(emit)
            flat = (grad * scale[ids]).astype(np.float32)
            for c in range(k):
                d_emit[:, c] = np.bincount(cells.ravel(), np.repeat(flat[:, c], width), BUCKETS + 1)
            d_emit[BUCKETS] = 0
            d_emit, d_trans = d_emit / len(batch), d_trans / len(batch) + 1e-3 * trans
            g_emit += d_emit**2
            g_trans += d_trans**2
            emit -= 0.5 * d_emit / np.sqrt(g_emit)
            trans -= 0.1 * d_trans / np.sqrt(g_trans)
    return Model(labels, emit[:BUCKETS], trans)


def training_sample(labelled: DataFrame, max_docs: int = MAX_FIT_DOCS, max_chars: int = MAX_FIT_CHARS, by: str = "doc_id") -> list[tuple[str, str]]:
    """About ``max_docs`` pairs (text, lang), chosen by a hash of ``by``, both present.

    A chosen text gives one passage of at most ``max_chars`` characters, at a hashed place,
    so that what the driver gets is bounded.
    """
    some = labelled.where("text is not null and lang is not null")
    n = some.count()
    h = F.xxhash64(F.coalesce(F.col(by).cast("string"), F.lit("")))
    if n > max_docs:
        some = some.where(F.pmod(h, F.lit(1 << 40)) < F.lit(int((1 << 40) * max_docs / n)))
    room = F.greatest(F.length("text") - max_chars, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(h), room.cast("long")).cast("int") + 1
    rows = some.select(F.substring(F.col("text"), start, F.lit(max_chars)).alias("text"), "lang", h.alias("h")).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["h"], r["text"], r["lang"]))]


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter, as ``identify`` finds letters."""
    at = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([bool(LETTERS.search((t or "").lower())) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input rows with lang_pred, score and word_counts (label -> words labelled so).

    Every word of the whole text is labelled; lang_pred has the highest mean posterior,
    which is the score.  Text that is null or has no letter gives ``und`` with score 0.
    Columns of those names in the input are kept under the names of ``set_aside``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.labels, model.emit, model.trans))
    new = NEW
    work = docs.withColumnsRenamed(set_aside(docs, new))
    at = work.columns.index(text)
    schema = work.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("array<int>").alias("word_counts")).schema

    def label(batches):
        own = Model(*shared.value)
        k = len(own.labels)
        for batch in batches:
            texts = batch.column(at)
            n = len(texts)
            pred, score, counts = ["und"] * n, np.zeros(n), [[0] * k for _ in range(n)]
            if not k:
                yield from _with(batch, pred, score, counts)
                continue
            waiting: list[tuple[int, list[str]]] = []
            total = 0

            def flush():
                lengths = np.array([len(w) for _, w in waiting])
                at_rows = own.ids([w for _, ws in waiting for w in ws])
                scores = own.rows[at_rows]
                post = own.marginals(scores, lengths)
                starts = np.cumsum(lengths) - lengths
                mean = np.add.reduceat(post, starts, axis=0) / lengths[:, None]
                top = np.eye(k, dtype=np.int64)[post.argmax(axis=1)]
                tally = np.add.reduceat(top, starts, axis=0)
                for (i, _), m, c in zip(waiting, mean, tally, strict=True):
                    b = int(m.argmax())
                    pred[i], score[i], counts[i] = own.labels[b], min(1.0, float(m[b])), c.tolist()
                waiting.clear()

            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            for i in np.argsort(sizes, kind="stable").tolist():  # a text is a Python object only while it is read
                words = LETTERS.findall((texts[i].as_py() or "").lower())
                if words:
                    waiting.append((i, words))
                    total += len(words)
                if total >= CHUNK_WORDS:
                    flush()
                    total = 0
            if waiting:
                flush()
            yield from _with(batch, pred, score, counts)

    def _with(batch, pred, score, counts):
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(counts, pa.list_(pa.int32()))],
            [*batch.schema.names, "lang_pred", "score", "word_counts"],
        )

    return work.mapInArrow(label, schema)

