"""Helpers shared by the operators: reading, shared scratch tables, prefix sums, tokens."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One token is a run of characters that are not ASCII white space.
SPACE_TOKEN = r"[^\x20\x09-\x0D]+"
#: One word is a run of digits, lower-case ASCII letters and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: WORD before A-Z are lowered.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``bytes.translate`` table: lowers A-Z and turns each byte outside WORD into a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(raw: bytes) -> list[bytes]:
    """The WORDs of UTF-8 bytes, A-Z lowered."""
    return raw.translate(WORD_BYTES).split()


def set_aside(docs: DataFrame, new: list[str] | tuple[str, ...]) -> dict[str, str]:
    """New names of the columns of ``docs`` that are called like one of ``new``:
    ``input_<name>``, with ``input_`` again where that is taken.  Case makes no difference."""
    taken, out = {c.lower() for c in (*docs.columns, *new)}, {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in new}:
            name = f"input_{c}"
            while name.lower() in taken:
                name = f"input_{name}"
            taken.add(name.lower())
            out[c] = name
    return out


def packed(docs: DataFrame) -> Column:
    """A row of ``docs`` as one struct: inside it no name can clash with an operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local master may do without the setting; it then gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders of the scratch tables made in the innermost ``scratch_scope``.
_OWNED: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables made inside it by this thread: for callers
    that write what they read from them before.  Other callers' tables stay."""
    own: list[str] = []
    before = _OWNED.set(own)
    try:
        yield
    finally:
        _OWNED.reset(before)
        for root in own:
            _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    They stay until ``drop`` or the end of a ``scratch_scope``, since results are read from
    them lazily.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        if (own := _OWNED.get()) is not None:
            own.append(self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self._read(df, path)

    def write_slices(self, slices: Iterable[DataFrame], name: str) -> DataFrame:
        """One table of slices written one after another, each taken when the one before is
        written and its shuffle files are let go: the disk holds those of a slice, not of all."""
        path = self.path(name)
        for df in slices:
            df.write.mode("append").option("compression", "zstd").parquet(path)
            self.release()
        return self._read(df, path)

    def _read(self, df: DataFrame, path: str) -> DataFrame:
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads, and the shuffle files behind them."""
        for t in tables:
            _delete(self.spark, t._scratch_path)
        self.release()

    def release(self) -> None:
        """Let go of the shuffle files of finished writes.

        Spark deletes a shuffle's files once the driver has collected the plan that made
        them; a driver with memory to spare does that long after the files are of use.
        """
        self.spark._jvm.System.gc()


def running_sums(df: DataFrame, scratch: Scratch, key: str, order: list[str], value: str, buckets: int) -> DataFrame:
    """Adds ``_before``: the sum of ``value`` over the rows of the same ``key`` that come
    earlier by (bucket of the first order column's hash, order columns).

    A plain window would put each key in one task.  Here a key is dealt into ``buckets``
    buckets by the md5 of the first order column; bucket totals are summed in order and each bucket is windowed alone.
    Keys compare null-safe.
    """
    digits = F.conv(F.substring(F.md5(F.col(order[0]).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    df = df.withColumn("_bucket", F.coalesce(F.pmod(digits, F.lit(buckets)), F.lit(0)).cast("int"))
    sums = df.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.write(
        sums.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_start")),
        "starts",
    )
    joined = df.join(starts, df[key].eqNullSafe(starts["_k"]) & (df["_bucket"] == starts["_b"]), "left")
    within = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(
        "_before", F.coalesce(F.col("_start"), F.lit(0)) + F.coalesce(F.sum(value).over(within), F.lit(0))
    ).drop("_k", "_b", "_start", "_bucket")
