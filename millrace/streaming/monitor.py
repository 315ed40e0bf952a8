"""Page states and snapshot changes as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = "url string, event_id long, changed boolean, unchanged_count long"
STATE = "digest string, unchanged_count long"


def page_states(visits: DataFrame, ttl_ms: int = 30 * 86_400_000, watermark: str = "1 day") -> DataFrame:
    """Streaming form of ``operators.diff.page_states``: visits (url, ts, event_id, digest).

    The state of a page is its last digest and a count; it goes when its page isn't
    visited for ``ttl_ms`` of event time.  Visits of one batch are taken in time order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, same = state.get if state.exists else (None, 0)
        first, out = not state.exists, []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for event_id, digest in zip(rows["event_id"], rows["digest"], strict=True):
            digest = digest if isinstance(digest, str) else None
            changed = first or digest is None or digest != before
            same = 0 if changed else same + 1
            out.append((key[0], event_id, changed, same))
            before, first = digest, False
        state.update((before, same))
        latest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame(out, columns=["url", "event_id", "changed", "unchanged_count"])

    marked = visits.withWatermark("ts", watermark)
    return marked.groupBy("url").applyInPandasWithState(step, STATES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_failures(events: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Failures by window and provider; late events are dropped past the watermark."""
    failed = events.where("event_type = 'error'").withWatermark("ts", watermark)
    return failed.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("provider")).agg(F.count("*").alias("failures"))


def last_snapshot(spark, path: str, before: int) -> int | None:
    """The number of the last whole snapshot of an earlier batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
    whole = lambda n: store.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))
    return max((int(n) for n in names if n.isdigit() and int(n) < before and whole(n)), default=None)


def snapshot_changes(path: str, key: str, fields: list[str], order: str, complete: bool = True):
    """A ``foreachBatch`` function: compares each batch with the last snapshot kept at ``path``
    (one folder a batch, so a batch that runs again gives the same) and appends events.  The first
    batch may have any number, and numbers may be missing.

    A ``complete`` batch holds all pages, so those absent from it are removed.  Otherwise
    it holds some: only its pages are compared, and the snapshot keeps the others.
    """
    from millrace.operators.diff import snapshot_diff
    from millrace.operators.ranking import best_per_key

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = best_per_key(batch, [key], [F.desc(order), *(F.col(f) for f in fields)]).select(key, *fields)
        last = last_snapshot(spark, path, batch_id)
        previous = current.limit(0) if last is None else spark.read.parquet(f"{path}/snapshot/{last}")
        met = previous if complete else previous.join(current.select(key), key, "left_semi")
        snapshot_diff(met, current, key, fields).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/events/batch_id={batch_id}")
        kept = current if complete else current.unionByName(previous.join(current.select(key), key, "left_anti"))
        kept.write.mode("overwrite").parquet(f"{path}/snapshot/{batch_id}")

    return run
