"""Cleaning playlists as they arrive in a folder, with memory between deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import first_per_link, row_keys
from ..operators.parse import PLACE, number_channels
from ..plans.clean import CleanOptions, Earlier, clean_channels
from ..schema import CHANNEL
from ..sources.playlists import WHOLE_FILE_BYTES, parse_files
from ..workspace import materialize, scratch

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


class Memory:
    """What earlier batches have seen and kept, as tables of keys in one folder.

    Every batch writes its own part and reads the parts before its own, so a batch
    that is repeated after a failure replaces what it wrote and finds what it found.
    Keys are 16 bytes long, whatever links and names are.
    """

    SCHEMAS = {
        "links": "link_key binary, batch long",
        "kept": "link_key binary, name_key binary, batch long",
        "contents": "content_hash string, name string, batch long",
    }

    def __init__(self, spark: SparkSession, folder: str, batch: int):
        self.spark, self.folder, self.batch = spark, folder, batch

    def before(self, table: str) -> DataFrame:
        """The rows of all earlier batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMAS[table])
        found = self.spark.read.schema(self.SCHEMAS[table]).parquet(f"{self.folder}/{table}")
        return found.where(F.col("batch") < self.batch)

    def remember(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={self.batch}")


def clean_delivery(
    spark: SparkSession,
    files: list[str],
    memory: Memory,
    options: CleanOptions,
    probes: DataFrame | None = None,
    responses: DataFrame | None = None,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """Channels of some files that no earlier delivery has had, cleaned.

    Links that an earlier delivery had go, as later ones do in a merge; rows whose
    link or name belongs to a row kept before go, as in one list; numbers go on;
    content flagged before is flagged again.
    """
    parsed = parse_files(spark, sorted(files), whole_file_bytes)
    merged = materialize(row_keys(first_per_link(parsed, PLACE)), "merged")
    seen = memory.before("links")
    fresh = merged.join(seen.select("link_key"), "link_key", "left_anti")
    loaded = materialize(number_channels(fresh.drop("link_key", "name_key")), "loaded")
    before = seen.count()
    loaded = loaded.withColumn("id", F.col("id") + F.lit(before))
    memory.remember("links", row_keys(loaded).select("link_key"))
    earlier = Earlier(memory.before("kept"), memory.before("contents"))
    cleaned = clean_channels(loaded, options, probes, responses, earlier=earlier)
    if cleaned.kept is not None:
        memory.remember("kept", row_keys(cleaned.kept).select("link_key", "name_key"))
    if options.content_duplicates:
        first = F.min_by("name", "id").alias("name")
        contents = cleaned.flagged.where("content_hash is not null").groupBy("content_hash").agg(first)
        known = memory.before("contents").select("content_hash")
        memory.remember("contents", contents.join(known, "content_hash", "left_anti"))
    return cleaned.channels


def start_cleaning(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    options: CleanOptions = CleanOptions(skip_validation=True),
    probes: Callable[[], DataFrame] | None = None,
    interval: str | None = None,
    responses: Callable[[], DataFrame] | None = None,
    files_per_batch: int | None = None,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> StreamingQuery:
    """Clean the playlists that are in the folder and not yet done.

    With an ``interval`` such as "1 minute" the query goes on watching the folder
    until it is stopped, else it takes all files there are and ends; at most
    ``files_per_batch`` files at a time.  Only names of files go through the stream;
    contents are read as those of any other source, compressed files and files of
    any size among them.

    Deliveries continue each other.  Files that arrive in the order of their names
    give the same kept channels, with the same numbers, in one batch or in many
    (sorting, where it is asked for, is by batch).  What was seen and kept is
    remembered under the checkpoint as 16 bytes per link and name.  A batch replaces
    its own part of the output and of the memory, so one that is repeated after a
    failure changes nothing.
    """
    source = spark.readStream.format("binaryFile").schema(_FILE)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    arriving = source.load(folder).select("path")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        files = [r.path for r in batch.collect()]
        memory = Memory(session, f"{checkpoint}/remembered", number)
        with scratch(session):
            cleaned = clean_delivery(
                session,
                files,
                memory,
                options,
                probes() if probes else None,
                responses() if responses else None,
                whole_file_bytes,
            )
            cleaned.select(CHANNEL.names).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": interval} if interval else {"availableNow": True}))
        .start()
    )
