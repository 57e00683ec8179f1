"""Pick up only the source files that were not ingested before, or changed since."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..sources.tables import path_exists


def ingest_new_files(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, fmt: str = "parquet",
    files_per_batch: int | None = None, **options: str,
) -> int:
    """Copy new files of ``source`` into the table at ``target``; returns the rows added.

    A file-source stream with a checkpoint remembers finished files, so a rerun skips them
    and a run that dies midway resumes; the file sink's own log keeps the output exactly once.
    """
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    run = (
        reader.load(source).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start(target)
    )
    run.awaitTermination()
    return sum(p["numInputRows"] for p in run.recentProgress)


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


SOURCE, RUN = "_source", "_run"
KNOWN = ["path", "modificationTime", "length"]
#: Source files that one write takes; their paths are all that the driver holds.
FILES_PER_WRITE = 10_000


def listing(spark: SparkSession, source: str) -> DataFrame:
    """Path, modification time and size of every source file; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select(
        *KNOWN, F.sha2("path", 256).alias(SOURCE))


def changed_files(spark: SparkSession, source: str, log: str) -> DataFrame:
    """The listed files whose latest entry in the log, if any, has another time or size."""
    found = listing(spark, source)
    if path_exists(spark, log):
        latest = spark.read.parquet(log).groupBy("path").agg(F.max(F.struct("turn", *KNOWN[1:])).alias("_l"))
        found = found.join(latest.select("path", *[F.col(f"_l.{c}").alias(c) for c in KNOWN[1:]]), KNOWN, "left_anti")
    return cut_lineage(found)


def next_turn(spark: SparkSession, log: str) -> int:
    return spark.read.parquet(log).agg(F.max("turn")).first()[0] + 1 if path_exists(spark, log) else 0


def read_files(spark: SparkSession, files: DataFrame, schema: T.StructType, fmt: str, options: dict) -> Iterator[DataFrame]:
    """Rows of the listed files with their source key, some files at a time."""
    paths = (r.path for r in files.select("path").toLocalIterator())
    while some := list(islice(paths, FILES_PER_WRITE)):
        rows = spark.read.format(fmt).schema(schema).options(recursiveFileLookup=True, **options).load(some)
        yield rows.withColumn(SOURCE, F.sha2(F.col("_metadata.file_path"), 256))


def ingest_changed_files(
    spark: SparkSession, source: str, target: str, schema: T.StructType, fmt: str = "parquet", **options: str,
) -> int:
    """Bring new and rewritten files of ``source`` into the table at ``target``; returns their number.

    A file is known by path, modification time and size.  Rows are appended in a few files per run, with the key of
    their source file and of the run; the log names the runs that hold the live rows of every source file and is
    appended after them.  What a run that died left behind is in no log and never read; the next one takes the same
    files again.
    """
    log = f"{target.rstrip('/')}_log"
    found = changed_files(spark, source, log)
    count = found.count()
    if not count:
        return 0
    run = uuid.uuid4().hex
    for rows in read_files(spark, found, schema, fmt, options):
        rows.withColumn(RUN, F.lit(run)).write.mode("append").parquet(target)
    found.withColumns({RUN: F.lit(run), "turn": F.lit(next_turn(spark, log)).cast("long")}).write.mode("append").parquet(log)
    return count


def read_current(spark: SparkSession, target: str) -> DataFrame:
    """The table of ``ingest_changed_files``: of every source file the rows of its latest logged run, without the keys."""
    live = spark.read.parquet(f"{target.rstrip('/')}_log").groupBy(SOURCE).agg(F.max_by(RUN, "turn").alias(RUN))
    return spark.read.parquet(target).join(live, [SOURCE, RUN], "left_semi").drop(SOURCE, RUN)
