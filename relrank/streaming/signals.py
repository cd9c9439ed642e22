"""Windowed service signals and stream deduplication, each with the batch form it must agree with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from relrank.functions import text as tx


def _signals(log: DataFrame, width: str) -> DataFrame:
    failed = F.col("status") != 200
    return (
        log.groupBy(F.window("ts", width).alias("w"))
        .agg(
            F.count("*").alias("requests"),
            F.count_if(failed).alias("failures"),
            F.round(F.avg("latency_ms"), 6).alias("mean_ms"),
            F.max("latency_ms").alias("max_ms"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            "requests",
            "failures",
            F.round(F.col("failures") / F.col("requests"), 6).alias("error_rate"),
            "mean_ms",
            "max_ms",
        )
    )


def windowed_signals(log: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Request count, error rate and latency per tumbling window; batch or stream."""
    return _signals(log.withWatermark("ts", lateness) if log.isStreaming else log, width)


def _partials(log: DataFrame, width: str) -> DataFrame:
    """Sums of a set of rows per window, which add up with those of other rows."""
    return log.groupBy(F.window("ts", width).start.alias("window_start")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") != 200).alias("failures"), F.sum("latency_ms").alias("latency"),
        F.count("latency_ms").alias("timed"), F.max("latency_ms").alias("max_ms"),
    )


def run_signals(log: DataFrame, path: str, checkpoint: str, width: str = "1 hour", lateness: str = "10 minutes") -> None:
    """Windows of a stream as tables below `path`, corrected by late rows. No state is kept between micro-batches.

    Each micro-batch writes sums per window that add up with those of others: of rows whose window was open to `windows`,
    of later ones to `corrections`, and the late rows themselves to `late`. A window is closed by the watermark: the
    latest time of the micro-batches before, less the lateness; those times are kept with the batches. A micro-batch
    overwrites its own folders, so one that runs again leaves nothing twice. `corrected` reads the result.
    """
    spark = log.sparkSession
    state = T.StructType([T.StructField("batch", T.LongType()), T.StructField("latest", T.TimestampType())])

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        folder = f"{path}/latest"
        seen = _existing(spark, folder, state)
        mark = seen.where(F.col("batch") < number).agg((F.max("latest") - F.expr(f"interval {lateness}")).alias("mark")).first()["mark"]
        ends = F.window("ts", width).end
        late = F.lit(False) if mark is None else ends <= F.lit(mark)
        parts = {"late": batch.where(late), "corrections": _partials(batch.where(late), width), "windows": _partials(batch.where(~late), width)}
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        latest = batch.agg(F.lit(number).cast("long").alias("batch"), F.max("ts").alias("latest"))
        latest.write.mode("overwrite").parquet(f"{folder}/part={number}")
        batch.unpersist()

    query = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _existing(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The table below a folder, empty before anything is written to it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def corrected(spark: SparkSession, path: str) -> DataFrame:
    """The windows of `run_signals` in the form of `windowed_signals`, with how many of their rows were late."""
    rows = spark.read.parquet(f"{path}/windows").withColumn("late", F.lit(0).cast("long"))
    late = spark.read.parquet(f"{path}/corrections").withColumn("late", F.col("requests"))
    sums = rows.unionByName(late).groupBy("window_start").agg(
        *[F.sum(c).alias(c) for c in ("requests", "failures", "latency", "timed", "late")], F.max("max_ms").alias("max_ms")
    )
    return sums.select(
        "window_start", "requests", "failures", F.round(F.col("failures") / F.col("requests"), 6).alias("error_rate"),
        F.round(F.col("latency") / F.nullif(F.col("timed"), F.lit(0)), 6).alias("mean_ms"), "max_ms", F.col("late").alias("late_requests"),
    )


def request_shape(requests: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Query-length and candidate-count distribution per window; batch or stream.

    `requests` has ts, query and candidate_count.
    """
    rows = requests.withWatermark("ts", lateness) if requests.isStreaming else requests
    length = F.size(tx.space_tokens(F.col("query")))
    return (
        rows.withColumn("query_length", length)
        .groupBy(F.window("ts", width).alias("w"), "query_length")
        .agg(
            F.count("*").alias("requests"),
            F.round(F.avg("candidate_count"), 6).alias("mean_candidates"),
            F.min("candidate_count").alias("min_candidates"),
            F.max("candidate_count").alias("max_candidates"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            "query_length",
            "requests",
            "mean_candidates",
            "min_candidates",
            "max_candidates",
        )
    )


BUCKETS = 4096  # groups of request keys that share one state


class _Reuse(StatefulProcessor):
    """Requests of a bucket of keys: those that wait for the watermark, and when the last answer of a key was stored.

    A request is decided once the watermark has passed it: nothing earlier can come then. A stored answer goes when it
    is older than the TTL.
    """

    def __init__(self, step: int, id_type: str) -> None:
        self.step, self.id_type = step, id_type

    def init(self, handle) -> None:
        self.handle = handle
        self.stored = handle.getListState("stored", "request_key string, micros long")
        self.waiting = handle.getListState("waiting", f"request_key string, micros long, request_id {self.id_type}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ("request_key", "micros", "request_id")
        added = [r for frame in rows for r in zip(*(frame[c].tolist() for c in columns))]
        added = [r for r in added if r[2] is not None and r[2] == r[2]]  # a row without request only moves the watermark
        if added:
            self.waiting.appendList(added)
            self.handle.registerTimer(_millis(min(r[1] for r in added)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in held if r[1] <= passed], [r for r in held if r[1] > passed]
        stored = dict(self.stored.get()) if self.stored.exists() else {}
        before, hits = dict(stored), []
        for name, micros, _ in due:
            last = stored.get(name)
            hits.append(last is not None and micros < last + self.step)
            if not hits[-1]:
                stored[name] = micros
        stored = {name: micros for name, micros in stored.items() if micros + self.step > passed}
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if stored != before:
            self.stored.put(list(stored.items())) if stored else self.stored.clear()
        if later:
            self.handle.registerTimer(_millis(min(r[1] for r in later)))
        if stored:
            # One timer for all: the answers that are too old by then go together.
            self.handle.registerTimer(_millis(max(stored.values()) + self.step))
        if due:
            yield pd.DataFrame({"request_id": [r[2] for r in due], "reused": hits})

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first millisecond at or after a time."""
    return -(-int(micros) // 1000)


def stream_reuse(log: DataFrame, ttl: float, lateness: str = "10 minutes") -> DataFrame:
    """`(request_id, reused)` for a stream of requests, by the rule of the batch `reuse`.

    Requests may come up to `lateness` behind the latest one, in any order: they wait in the state of their key's
    bucket until the watermark has passed them. A state per bucket, not per key, since most keys have few requests and
    each state costs a worker several calls a micro-batch. Later ones are dropped and counted by Spark (numRowsDroppedByWatermark). A row without
    request_id is no request, it only moves the watermark: `closing_row` makes the one that ends a stream.
    The state needs the RocksDB store, which `stateful` sets for a session.
    """
    id_type = log.schema["request_id"].dataType.simpleString()
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.withWatermark("ts", lateness).select("request_id", F.coalesce("request_key", F.lit("")).alias("request_key"), "ts", micros.alias("micros"))
    # Rows without request have a bucket of their own: a null would turn the ids of its group into fractions.
    bucket = F.when(F.col("request_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("request_key"), F.lit(BUCKETS)))
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        _Reuse(int(ttl * 1_000_000), id_type), f"request_id {id_type}, reused boolean", "Append", "EventTime"
    )


def closing_row(log: DataFrame, after: str) -> DataFrame:
    """One row like those of `log`, `after` (an interval) later than all of them and otherwise empty."""
    end = log.agg((F.max("ts") + F.expr(f"interval {after}")).alias("ts"))
    kind = {f.name: f.dataType for f in log.schema.fields}
    return end.select(*[F.col("ts").cast(kind[c]).alias(c) if c == "ts" else F.lit(None).cast(kind[c]).alias(c) for c in log.columns])


def stateful(spark: SparkSession) -> None:
    """Keeps stream state in RocksDB, off the heap and with timers."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes everything available, then stops."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes everything available, then stops; every micro-batch writes the groups that it changed.

    Nothing waits for a watermark, so the last windows are there as well. `latest` reads the current rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last micro-batch for each key of a table written by `run_updates`."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in values])
