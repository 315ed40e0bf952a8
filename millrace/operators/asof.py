"""What was known at a run: the latest row of each of several histories, at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(runs: DataFrame, histories: dict[str, tuple[DataFrame, list[str]]], by: list[str], at: str = "at", tie: str = "id", span: str = "day") -> DataFrame:
    """The runs with a struct column for each history: its ``values`` and ``at`` of the latest row
    of the same ``by`` at or before the run, the largest ``tie`` of equal times; null where there is none.

    A history is (rows, value columns) with ``by``, ``at`` and ``tie``.  Runs and histories are one
    union that is shuffled once, by ``by`` and the ``span`` that the time falls in, so a busy key is
    many groups.  What earlier spans of a key leave is carried over a table of one row a key and
    span.  Rows without a time, and histories' rows without a key, are known at no run; a run without a time knows
    nothing.  Late rows count by their own time, whenever they arrive.  Other columns of ``runs``
    keep their names; empty histories give nulls.
    """
    names = list(histories)
    kinds = {n: F.struct(F.col(at), *(F.col(v) for v in values)) for n, (_, values) in histories.items()}
    types = {n: rows.select(kinds[n].alias("x")).schema["x"].dataType for n, (rows, _) in histories.items()}
    run = F.struct(*(F.col(f"`{c}`") for c in runs.columns))
    none = lambda n: F.lit(None).cast(types[n])
    keys = lambda df: [F.col(b) for b in by]
    rows = runs.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), run.alias("_run"), *(none(n).alias(n) for n in names))
    run_type = runs.select(run.alias("x")).schema["x"].dataType
    for n in names:
        h = histories[n][0].where(F.col(at).isNotNull())
        for b in by:
            h = h.where(F.col(b).isNotNull())
        rows = rows.unionByName(h.select(*keys(h), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.lit(None).cast(run_type).alias("_run"), *((kinds[n] if m == n else none(m)).alias(m) for m in names)))
    rows = rows.withColumn("_span", F.date_trunc(span, "_at"))
    order = ["_at", "_side", "_tie"]  # at one time, histories come before runs
    upto = Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = lambda n: F.last(n, ignorenulls=True)
    within = rows.select(*by, "_span", "_at", "_run", *(held(n).over(upto).alias(n) for n in names)).where("_run is not null")
    place = F.struct(*order)
    left = rows.where("_side = 0").groupBy(*by, "_span").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), place)).alias(n) for n in names))
    spans = left.unionByName(rows.where("_side = 1").select(*by, "_span").distinct().select(*by, "_span", *(none(n).alias(n) for n in names)))
    one = spans.groupBy(*by, "_span").agg(*(F.first(n, ignorenulls=True).alias(n) for n in names))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = one.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), F.col("_span").alias("_s"), *(held(n).over(before).alias(f"_c_{n}") for n in names))
    same: Column = F.col("_span").eqNullSafe(F.col("_s"))
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    joined = within.join(carried, same, "left")
    known = lambda n: F.when(F.col("_at").isNotNull(), F.coalesce(n, f"_c_{n}")).alias(n)
    return joined.select("_run", *(known(n) for n in names)).select("_run.*", *names)
