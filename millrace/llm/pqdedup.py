"""Embedding near-duplicates by product quantisation over inverted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

#: Bounds of the fit (vectors), lists, subspaces and codewords of each.
MAX_FIT = 16_384
MAX_LISTS = 1024
LIST_SIZE = 1500
SUBSPACES = 8
CODES = 256
#: Rows of a block of a list, and of the queries that meet it.
INDEX_BLOCK, QUERY_BLOCK = 1024, 2048


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _distances(x, c).argmin(axis=1)


class Quantiser:
    """Coarse centroids of unit vectors, and codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.coarse = _kmeans(sample, lists, rng)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, p], CODES, rng) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home list, codes, distance of each vector to what its codes stand for)."""
        home = _nearest(x, self.coarse)
        rest = x - self.coarse[home]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        error = rest.copy()
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            error[:, p] -= b[codes[:, j]]
        return home, codes.astype(np.uint8), np.sqrt((error * error).sum(1))

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float, slack: float) -> np.ndarray:
        """(rows, lists): the lists that a vector within ``reach`` may lie in.

        Such a vector lies beyond the plane between two centroids only if the query's
        distance to that plane is at most its step across it.  ``slack`` is the largest
        step considered, as a share of ``reach``: 1 is exact for any direction.
        """
        d = _distances(x, self.coarse)
        gap = d - d[np.arange(len(x)), home][:, None]
        between = np.sqrt(_distances(self.coarse, self.coarse))[home]
        out = gap <= 2 * slack * reach * between + 1e-12
        out[np.arange(len(x)), home] = True
        return out

    def scan(self, q: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs that may be within ``reach``: asymmetric distances from
        look-up tables, less the quantisation error of the row."""
        rest = q - self.coarse[at]
        total = np.zeros((len(q), len(codes)), np.float32)
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            total += _distances(rest[:, p], b).astype(np.float32)[:, codes[:, j]]
        return np.nonzero(total <= ((reach + error) ** 2 * 1.001 + 1e-5).astype(np.float32)[None])


def _clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    e = F.col(embedding).cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    ok = F.col(embedding).isNotNull() & F.coalesce(fine, F.lit(False))
    return vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.when(ok, e).alias("e"),
        F.when(ok, F.xxhash64(e)).alias("h1"), F.when(ok, F.xxhash64(F.lit(1), e)).alias("h2"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of equal length, in double precision."""
    x = np.array(column.to_pylist(), float) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _links(classes: DataFrame, n: int, threshold: float, slack: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((id, n) links of each class of one dimension, (a, b) spanning links)."""
    spark = classes.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    sample = classes.where(F.pmod(F.xxhash64("h1"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, MAX_FIT / max(1, n))))).select("h1", "e").collect()
    sample = sorted(sample, key=lambda r: r["h1"])
    book = Quantiser(_matrix(pa.array([r["e"] for r in sample])), min(MAX_LISTS, max(4, n // LIST_SIZE))) if sample else None
    if book is None:
        return spark.createDataFrame([], "id long, n long"), spark.createDataFrame([], "a long, b long")
    shared = spark.sparkContext.broadcast(book)

    def encode(batches):
        own: Quantiser = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("e"))
            home, codes, error = own.encode(x)
            probes = own.probes(x, home, reach, slack)
            raw = x.astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copies"), pa.array(home, pa.int32()), pa.array([np.flatnonzero(p) for p in probes], pa.list_(pa.int32())),
                 pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                ["id", "copies", "home", "probes", "x", "codes", "error"],
            )

    coded = scratch.write(classes.mapInArrow(encode, "id long, copies long, home int, probes array<int>, x binary, codes binary, error double"), "coded")
    probing = coded.select("id", "copies", "home", "x", F.explode("probes").alias("list"))
    sizes = {r[0]: r[1] for r in coded.groupBy("home").count().collect()}  # a row a list
    asked = {r[0]: r[1] for r in probing.groupBy("list").count().collect()}
    blocks = spark.createDataFrame([(k, -(-sizes.get(k, 0) // INDEX_BLOCK), -(-asked[k] // QUERY_BLOCK)) for k in asked if sizes.get(k)] or [(-1, 1, 1)], "b int, ni int, nq int")
    none = lambda t: F.lit(None).cast(t)
    index = coded.join(F.broadcast(blocks), F.col("home") == F.col("b")).select(
        F.col("home").alias("list"), F.pmod(F.xxhash64("id", F.lit(1)), "ni").alias("ib"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - F.lit(1).cast("long"))).alias("qb"),
        F.lit(False).alias("asks"), "id", "copies", "home", "probes", "x", "codes", "error",
    )
    query = probing.join(F.broadcast(blocks), F.col("list") == F.col("b")).select(
        "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - F.lit(1).cast("long"))).alias("ib"), F.pmod(F.xxhash64("id", F.lit(2)), "nq").alias("qb"),
        F.lit(True).alias("asks"), "id", "copies", "home", none("array<int>").alias("probes"), "x", none("binary").alias("codes"), none("double").alias("error"),
    )

    def block(table: pa.Table) -> pa.Table:
        own: Quantiser = shared.value
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        q, r = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        out_a, out_b, out_n = [], [], []
        if len(q) and len(r):
            at = q.column("list")[0].as_py()
            mat = lambda t: np.frombuffer(b"".join(t.column("x").to_pylist()), "<f8").reshape(len(t), -1)
            xq, xr = mat(q), mat(r)
            codes = np.frombuffer(b"".join(r.column("codes").to_pylist()), np.uint8).reshape(len(r), -1)
            qi, ri = q.column("id").to_numpy(), r.column("id").to_numpy()
            qc, rc = q.column("copies").to_numpy(), r.column("copies").to_numpy()
            qh = q.column("home").to_numpy()
            asked_back = [set(p) for p in r.column("probes").to_pylist()]
            nq, nr = np.zeros(len(q), np.int64), np.zeros(len(r), np.int64)
            up = np.arange(len(q) + len(r))

            def root(i):
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            for a in range(0, len(q), 256):
                i, j = own.scan(xq[a : a + 256], at, codes, r.column("error").to_numpy(), reach)
                i = i + a
                for k in range(0, len(i), 20_000):
                    ii, jj = i[k : k + 20_000], j[k : k + 20_000]
                    ok = (np.einsum("ij,ij->i", xq[ii], xr[jj]) >= threshold) & (qi[ii] != ri[jj])
                    ii, jj = ii[ok], jj[ok]
                    np.add.at(nq, ii, rc[jj])
                    # the row's own query finds the pair too, unless it doesn't probe this home
                    silent = np.fromiter((qh[x] not in asked_back[y] for x, y in zip(ii, jj, strict=True)), bool, len(ii))
                    np.add.at(nr, jj[silent], qc[ii[silent]])
                    for x, y in zip(ii.tolist(), jj.tolist(), strict=True):
                        u, v = root(x), root(len(q) + y)
                        if u != v:
                            up[u] = v
                            out_a.append(int(qi[x]))
                            out_b.append(int(ri[y]))
                            out_n.append(0)
            for ids, counts in ((qi, nq), (ri, nr)):
                some = counts > 0
                out_a += ids[some].tolist()
                out_b += ids[some].tolist()
                out_n += counts[some].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "n": pa.array(out_n, pa.int64())})

    found = scratch.write(index.unionByName(query).groupBy("list", "ib", "qb").applyInArrow(block, "a long, b long, n long"), "found")
    return found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), found.where("n = 0").select("a", "b").distinct()


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, slack: float = 0.5, vec_id: str = "vec_id", embedding: str = "embedding", scratch: Scratch | None = None
) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per input row.

    Equal vectors are one class.  Each class is indexed in its nearest list with the codes
    of its residual, and queried against every list that a vector at the threshold may lie
    in (``Quantiser.probes``).  Blocks of a list meet blocks of its queries: look-up-table
    distances, bounded by the quantisation error, choose the pairs whose cosine is computed
    in double precision.  A block gives counts and a spanning set of its links, never pairs.

    Null, zero and non-finite vectors link with nothing; vectors link within a dimension.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "pq")
    rows = scratch.write(_clean(vectors, vec_id, embedding), "rows")
    classes = rows.where("h1 is not null and vec_id is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("e").alias("e"), F.first(F.size("e")).alias("dim")
    )
    classes = scratch.write(classes, "classes")
    counts = links = None
    for r in classes.groupBy("dim").count().collect():  # dimensions are few
        c, k = _links(classes.where(F.col("dim") == r["dim"]), r["count"], threshold, slack, scratch)
        counts, links = (c, k) if counts is None else (counts.union(c), links.union(k))
    if counts is None:
        counts, links = vectors.sparkSession.createDataFrame([], "id long, n long"), vectors.sparkSession.createDataFrame([], "a long, b long")
    comp = connected_components(links, scratch)
    per = classes.select("h1", "h2", "id", "copies").join(counts, "id", "left").join(comp, F.col("id") == F.col("node"), "left").select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    per = scratch.write(per.where((F.col("n_links") > 0)), "linked")
    out = rows.select("vec_id", "h1", "h2").join(per, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("vec_id").isNotNull(), "left")
    own = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept")
    )
