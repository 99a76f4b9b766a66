"""Streaming daily timeline state (optional extension of SURVEY 2.M; not a parity claim).

``events`` arrive as files.  Two stateful operators follow each other.  A windowed aggregation keeps, per user and open UTC
day, the sum of the values and the counts; when the watermark passes a day's end the day closes and goes on as one row with
the FB2 daily indicators and the composite risk (I17).  A second operator keyed by ``user_id``
(``transformWithState``) keeps, per user, the last seven days' composite risks, the run of risky days and the number
of days, and adds the rules that need the days before: 7-day rolling mean (E2), run of risky days (E4) and the history gate
(E12).  Days close in order, those of one batch are put in order, so it needs neither timers nor open days of its own: its
work is one read and one write of a small state per user and batch, however many events a day has.  Rows of days that have
closed are dropped by Spark before they reach the state.

A bounded replay ends with an end mark, a row far enough ahead that the watermark passes every open day, so the last
days close like all others and the result is that of the batch plan.  A mark carries no event.

Events are summed up in Spark before and after the shuffle, so a hot user costs neither a large state value nor task
memory.  The checkpoint (on the shared ``spark.checkpoint.dir``) makes the query restartable after executor or driver loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HISTORY = 7
RISKY_AT = 7.0
MIN_DAYS = 7
END_MARK = "end-of-feed"
#: Rows of one file of a replayed feed.
ROWS_PER_FILE = 200_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT_SCHEMA = ("user_id long, day timestamp, n_events long, Stress double, Sleep double, Workload double, "
                 "CompositeRisk double, RollingMean_7D double, ConsecutiveRiskDays int, history_len int, "
                 "status string")
NAMES = [c.split()[0] for c in OUTPUT_SCHEMA.split(", ")]


class DailyState(StatefulProcessor):
    """The last week and the run of one user, over its closed days."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "week array<double>, run int, days int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.past.get()
        week, run, days = (list(before[0]), before[1], before[2]) if before is not None else ([], 0, 0)
        for r in sorted(rows, key=lambda r: r["day"]):
            risk = r["CompositeRisk"]
            # added from left to right, as a window does: sum() would compensate the rounding
            week = (week + [risk])[-HISTORY:]
            run, days = (run + 1 if risk > RISKY_AT else 0), days + 1
            yield Row(**{c: r[c] for c in NAMES[:7]}, RollingMean_7D=reduce(add, week) / len(week), ConsecutiveRiskDays=run,
                      history_len=days, status="ok" if days >= MIN_DAYS else "insufficient_data")
        self.past.update((week, run, days))

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State in RocksDB, which ``transformWithState`` needs, while a query of ours is started and run."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _indicators(d: DataFrame) -> DataFrame:
    """FB2 daily indicators and the composite risk from one row per day (av, n_events, e)."""
    from ..operators.timeline import composite_risk
    n = F.col("n_events")
    d = d.select("user_id", "day", "n_events",
                 F.least(F.lit(10.0), F.round("av", 4) / 12.0).alias("Stress"),
                 F.when(n % 5 == 0, F.lit(None)).otherwise(F.least(F.lit(10.0), 3.0 + n * 1.5)).alias("Sleep"),
                 F.when((n == 1) & (F.col("e") == 0), F.lit(None))
                 .otherwise(F.least(F.lit(10.0), 10.0 * F.col("e") / n)).alias("Workload"))
    return composite_risk(d, cols=("Stress", "Workload")).drop("IsSevere")


def daily_state_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stateful transformation of a streaming DataFrame.  Rows without a time or a value belong to no day's sum and
    are left out; rows without a user are one user of their own."""
    ev = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    ev = ev.where("ts is not null and value is not null").withWatermark("ts", delay)
    real = F.coalesce(F.col("event_type") != END_MARK, F.lit(True))
    days = ev.groupBy("user_id", F.window("ts", "1 day")).agg(
        F.avg(F.when(real, F.col("value"))).alias("av"), F.count_if(real).alias("n_events"),
        F.count_if(F.col("event_type") == "error").alias("e")).where("n_events > 0")
    closed = _indicators(days.withColumn("day", F.col("window.start").cast("timestamp")))
    return closed.groupBy("user_id").transformWithState(DailyState(), OUTPUT_SCHEMA, "append", "None")


def run_available(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  files_per_trigger: int = 1, delay: str = "1 hour") -> DataFrame:
    """Process every file present in ``source_dir`` (``availableNow``) into a parquet sink."""
    schema = spark.read.parquet(source_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    with rocksdb_state(spark):
        q = (daily_state_stream(stream, delay).writeStream.format("parquet").outputMode("append")
             .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(OUTPUT_SCHEMA).parquet(sink_dir)


def write_end_mark(spark: SparkSession, source_dir: str, ahead: timedelta = timedelta(days=3)) -> None:
    """One more file that ends a feed: a row ``ahead`` of its last event, without an event.  ``ahead`` must be above the
    watermark's delay and one day."""
    feed = spark.read.parquet(source_dir)
    last = feed.agg((F.max(F.col("ts").cast("timestamp")) + F.lit(ahead)).alias("ts")).where("ts is not null")
    own = {"ts": F.col("ts"), "event_type": F.lit(END_MARK), "value": F.lit(0.0)}
    last.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in feed.schema.fields]).coalesce(1) \
        .write.mode("append").parquet(source_dir)


def daily_state_batch(events: DataFrame) -> DataFrame:
    """The same rules as one batch plan (window functions), for checking the stream."""
    from pyspark.sql.window import Window
    from ..operators.timeline import run_length
    d = events.where("ts is not null and value is not null").groupBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(
        F.avg("value").alias("av"), F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == "error").alias("e"))
    d = _indicators(d)
    w = Window.partitionBy("user_id").orderBy("day")
    return d.select("*", F.avg("CompositeRisk").over(w.rowsBetween(-(HISTORY - 1), 0)).alias("RollingMean_7D"),
                    run_length((F.col("CompositeRisk") > RISKY_AT).cast("int"), w).alias("ConsecutiveRiskDays"),
                    F.row_number().over(w).cast("int").alias("history_len")).withColumn(
        "status", F.when(F.col("history_len") >= MIN_DAYS, "ok").otherwise("insufficient_data"))


def files_per_piece(events: DataFrame, pieces: int = 6) -> int:
    """Files that each of the ``pieces`` of :func:`split_by_time` can be dealt into: enough for ``ROWS_PER_FILE`` rows a
    file, but so few that even the smallest piece surely fills all of them, whatever partitions its rows come from."""
    sizes = [n for n in _pieces(events, pieces)[1] if n]
    scan = events.rdd.getNumPartitions()
    return max(1, min(-(-max(sizes, default=1) // ROWS_PER_FILE), min(sizes, default=1) // max(scan, 1)))


def _pieces(events: DataFrame, pieces: int) -> tuple[list[tuple[int, int]], list[int]]:
    """The ranges of time (from, to; microseconds) of the pieces, and the rows in each."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(us), F.max(us)).first()
    if lo is None:
        return [], []
    step = (hi - lo) // pieces + 1
    at = ((us - lo) - (us - lo) % step) / step  # exact: a whole number
    found = {int(r[0]): r[1] for r in events.where(us.isNotNull()).groupBy(at).count().collect()}  # a row per piece
    return [(lo + i * step, lo + (i + 1) * step) for i in range(pieces)], [found.get(i, 0) for i in range(pieces)]


def split_by_time(events: DataFrame, path: str, pieces: int = 6, files: int = 1) -> str:
    """Write ``events`` as ``pieces`` sequential sets of ``files`` files in event-time order (a replayable feed, ``files`` of
    it at a time; see :func:`files_per_piece`).  All tasks read, and each of ``files`` tasks writes.  Rows without a time,
    and tables without rows, give none."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ranges, sizes = _pieces(events, pieces)
    if not ranges:
        events.where("false").write.mode("append").parquet(path)
        return path
    for (start, end), n in zip(ranges, sizes):
        if n or files == 1:  # a piece without rows would be one file
            events.filter((us >= start) & (us < end)).repartition(files).write.mode("append").parquet(path)
    return path
