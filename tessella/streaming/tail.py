"""Streaming twins: log tail with rollback state, staleness, history upsert, and event windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..stage import new_path

MOST_STEPS = 4096


def log_tail(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """(run, value, file) lines of log files as they appear; the file source reads whole files only, and a rotated file is a new one."""
    lines = spark.readStream.option("pathGlobFilter", glob).text(path)
    return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("run"), "value", F.col("_metadata.file_path").alias("file"))


def rollback_stream(points: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """Points (run, step, loss) in arrival order to (run, n, last_step, last_loss); a lower step removes the higher ones before it, an equal step is replaced.

    A run's state holds ``most`` steps at most, the newest; ``n`` counts what
    was there before them too.
    """

    def run(key, batches, state: GroupState):
        steps, losses, older = map(list, state.get) if state.exists else ([], [], [0])
        for pdf in batches:
            for step, loss in zip(pdf["step"].tolist(), pdf["loss"].tolist()):
                while steps and steps[-1] >= step:
                    steps.pop(), losses.pop()
                steps.append(int(step)), losses.append(float(loss))
            if len(steps) > most:
                older = [older[0] + len(steps) - most]
                steps, losses = steps[-most:], losses[-most:]
        state.update((steps, losses, older))
        yield pd.DataFrame({"run": [key[0]], "n": [older[0] + len(steps)], "last_step": [steps[-1]], "last_loss": [losses[-1]]})

    return points.groupBy("run").applyInPandasWithState(run, "run string, n long, last_step long, last_loss double", "steps array<long>, losses array<double>, older array<long>", "update", GroupStateTimeout.NoTimeout)


def run_states(lines: DataFrame) -> DataFrame:
    """(run, state, last_ts) of lines (run, ts, value): finished, error, paused or live, by the last line that says so."""
    v = F.col("value")
    state = F.when(v.contains("target reached"), "finished").when(v.contains("training failed") | v.contains("Traceback (most recent call last)"), "error").when(v.contains("stopped step="), "paused").when(v.contains("tok/s=") & v.contains("tokens="), "live")
    return lines.withColumn("said", state).groupBy("run").agg(F.max_by(F.col("said"), F.when(F.col("said").isNotNull(), F.col("ts"))).alias("state"), F.max("ts").alias("last_ts"))


def stale(states: DataFrame, now: str, pause_s: int = 180, warn_s: int = 300, alert_s: int = 900) -> DataFrame:
    """Adds ``shown`` (a live run without news for ``pause_s`` seconds is paused) and ``level``; a finished run is never stale. ``now`` is a column or literal."""
    age = F.unix_timestamp(F.expr(now)) - F.unix_timestamp("last_ts")
    level = F.when(F.col("state") == "finished", "ok").when(age > alert_s, "alert").when(age > warn_s, "warn").otherwise("ok")
    return states.withColumn("shown", F.when((F.col("state") == "live") & (age > pause_s), "paused").otherwise(F.col("state"))).withColumn("level", level)


def upsert_history(stream: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Each micro-batch replaces the rows of its keys in the Parquet table at ``path`` (written as a new version, then named in ``current``)."""
    spark = stream.sparkSession

    def merge(batch, batch_id):
        old = _current(spark, path)
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        out = newest if old is None else newest.unionByName(old.join(newest.select(*keys), keys, "left_anti"))
        out.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        spark.range(1).select(F.lit(f"v{batch_id}").alias("version")).write.mode("overwrite").json(f"{path}/current")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def _current(spark: SparkSession, path: str) -> DataFrame | None:
    from ..sources.formats import exists

    if not exists(spark, f"{path}/current"):
        return None
    return spark.read.parquet(f"{path}/{spark.read.json(f'{path}/current').first().version}")


def history(spark: SparkSession, path: str) -> DataFrame:
    out = _current(spark, path)
    if out is None:
        raise ValueError(f"nothing written at {path}")
    return out


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def stream_join(left: DataFrame, right: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(left_id, right_id): a user's right events at most ``within`` after a left one; state older than the watermark allows is dropped."""
    a = left.select(F.col("event_id").alias("left_id"), F.col("user_id").alias("u"), F.col("ts").alias("t")).withWatermark("t", late)
    b = right.select(F.col("event_id").alias("right_id"), "user_id", "ts").withWatermark("ts", late)
    return a.join(b, (F.col("u") == F.col("user_id")) & (F.col("ts") >= F.col("t")) & (F.col("ts") <= F.col("t") + F.expr(f"interval {within}"))).select("left_id", "right_id")


def run_once(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain what is there now into Parquet files of the shared folder and read them; each batch of a complete result replaces the one before."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "stream-" + name)
    if mode == "append":
        q = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    else:
        q = (df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path))
             .option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
