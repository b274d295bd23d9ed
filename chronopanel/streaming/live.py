"""Streaming extension over tick files: windowed aggregates with late data, and a carried one-step variance.

The batch engine has no streams; these follow its semantics on unbounded input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronopanel.operators.egarch import FLOOR, Params, step_log

TICK = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(ticks: DataFrame, width: str = "1 hour", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean, low, high of each window and type; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ticks.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select("w.start", "w.end", "event_type", "n", "mean", "low", "high")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "user_id", "n", "total")


def live_variance(ticks: DataFrame, prm: Params, first: float = 1.0) -> DataFrame:
    """series, ts, e, sigma2: the variance forecast of each value before it is seen; state is the last ln s2 and shock of a series."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ln, z, seen = state.get if state.exists else (math.log(first), 0.0, 0)
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            out = []
            for e in pdf["e"]:
                if seen:
                    ln = step_log(prm.omega, prm.alpha, prm.gamma, prm.beta, prm.kappa, [ln], [z])
                s2 = max(math.exp(ln), FLOOR)
                out.append(s2)
                z, seen = e / math.sqrt(s2), seen + 1
            yield pd.DataFrame({"series": key[0], "ts": pdf["ts"], "e": pdf["e"], "sigma2": out})
        state.update((ln, z, seen))

    return ticks.groupBy("series").applyInPandasWithState(run, "series string, ts timestamp, e double, sigma2 double", "ln double, z double, seen long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available now, as a table in memory (for tests and small replays)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Append to Parquet; restarts go on where the checkpoint ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
