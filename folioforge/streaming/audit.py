"""Audit events as a stream: latest state of each document, counts by time."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from folioforge.session import file_system, scratch

EVENTS = "id bigint, document_id bigint, action string, previous_status string, new_status string, logged_at timestamp_ntz, reason string, performed_by string"


def read_events(spark: SparkSession, path: str, glob: str, files_at_once: int = 8) -> DataFrame:
    """Files of events as they arrive in a folder: files of that name at any depth, and all files in folders of that name right in it, as a table written in parts has them."""

    def arriving() -> DataStreamReader:
        return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True)

    named = arriving().option("pathGlobFilter", glob).parquet(path)
    # a file of that name in a folder of that name is read once
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    parts = arriving().parquet(f"{path}/{glob}/[^_.]*").filter(~F.col("_metadata.file_name").rlike(f"^(?:{name})$"))
    df = named.unionByName(parts)
    return df.withColumn("logged_at", F.col("logged_at").cast("timestamp"))


def latest_state(events: DataFrame) -> DataFrame:
    """Of each document the state after its event of the greatest id; late events don't set it back."""
    return events.groupBy("document_id").agg(F.max_by("new_status", "id").alias("status"), F.max("id").alias("last_event"))


def hourly_actions(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and action; events later than the watermark allows are left out of closed hours."""
    return events.withWatermark("logged_at", late).groupBy(F.window("logged_at", "1 hour"), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "action", "n")


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its table, without rows where nothing is there; mode: complete or append."""
    if mode not in ("complete", "append"):
        raise ValueError(mode)
    spark = stream.sparkSession
    path = scratch(spark, f"stream-{name}")

    def table() -> DataFrame:
        system, at = file_system(f"{path}/out")
        if system.get_file_info(at).type == fs.FileType.NotFound:  # no batch ran
            return spark.createDataFrame([], stream.schema)
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    if mode == "append":
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        return table()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return table()
