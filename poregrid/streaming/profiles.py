"""Growing simulations: profiles that follow new files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def bottleneck_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """Rows of Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_profile(rows: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Figures of each cluster and window of loading time; rows later than ``late`` are left out.

    Sums and counts are kept, so windows can be added up to any longer one.
    """
    value = F.when(F.col("throughput").between(0, 1), F.col("throughput"))
    return (
        rows.withWatermark("loaded_at", late)
        .groupBy(F.window("loaded_at", width), "md_traj", "tunnel_cluster")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.sum(value).alias("throughput_sum"), F.max(value).alias("throughput_max"))
        .select(F.col("window.start").alias("window_start"), "md_traj", "tunnel_cluster", "n_rows", "n_values", "throughput_sum", "throughput_max")
    )


def start(profile: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to a Parquet table, exactly once."""
    return profile.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
