"""Structured Streaming forms of the incremental operations, each equal to its batch form when drained."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.session import shared_folder

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str, schema: str = EVENTS, files_a_batch: int = 100) -> DataFrame:
    """New files of a folder, or of one file name in its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """All that is there now, processed to the end into Parquet in the shared folder, and read back; in update mode
    with a key the last row of each."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    if mode == "complete":  # the last epoch holds all
        last = out.agg(F.max("epoch").alias("_e"))
        out = out.join(F.broadcast(last), out["epoch"] == F.col("_e")).drop("_e")
    if mode == "update" and key is not None:  # the last epoch of each key
        rest = [c for c in out.columns if c not in (key, "epoch")]
        return out.groupBy(key).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(key, "_r.*")
    return out.drop("epoch")


def counters(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def rate_windows(events: DataFrame, length: str = "60 seconds", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Calls per window, for a quota; windows follow each other, or slide, and close when the watermark has passed."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")


def first_seen(events: DataFrame, key: list[str], late: str | None = None) -> DataFrame:
    """Each key once, in whatever batch and order it comes; the state holds every key. With ``late`` only keys
    within the watermark are held: rows later than it are dropped, and a key can come out again after it."""
    if late is None:
        return events.dropDuplicates(key)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def taps(events: DataFrame, key: str, step: str) -> DataFrame:
    """A counter of each key that steps up and down and never falls below 0, after each batch."""
    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for x in pd.concat(list(parts)).sort_values(["ts", step])[step]:
            n = max(0, n + int(x))
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long", "n long", "update", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, guard_ms: int = 4000, forget: str | None = None) -> DataFrame:
    """``(user_id, value)`` after each batch: a smaller value within 4 s of the stored one is an echo.

    The state holds a value for each user; with ``forget`` (milliseconds as text) it is dropped after a user has been
    silent for so long, who then begins anew.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "value"])
        for ts, v in zip(rows["ts"], rows["value"]):
            ms = int(ts.timestamp() * 1000)
            if value is None or v >= value or ms - at >= guard_ms:
                value, at = float(v), ms
        state.update((value, at))
        if forget is not None:
            state.setTimeoutDuration(int(forget))
        yield pd.DataFrame({"user_id": [key[0]], "value": [value]})

    limit = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, value double", "value double, at long", "update", limit)


def new_only(batch: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """The rows of a batch whose key the ledger lacks: idempotent re-processing of files."""
    return batch.dropDuplicates([key]).join(ledger.select(key).distinct(), key, "left_anti")
