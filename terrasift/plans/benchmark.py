"""Benchmark runs over a corpus: resumable, append-only, summarised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.operators import corpus, gate
from terrasift.plans import pipeline
from terrasift.sinks import kml

Process = Callable[[DataFrame], DataFrame]
IDENTITY = ["path", "size", "mtime"]


def results(records: DataFrame, target: str) -> DataFrame | None:
    """The rows that earlier runs left under the target; None before the first."""
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(target) if files.exists(folder) and files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/run_id=*")) else None


def run(records: DataFrame, process: Process, target: str, run_id: str, identity: list[str] | None = None) -> DataFrame:
    """ORC-07, ORC-08: process the records that no run has a result of, and append to the run's partition.

    A run that stopped resumes with what is left: Spark's commit leaves whole results or none.
    """
    keys = identity or IDENTITY
    done = results(records, target)
    left = records if done is None else corpus.unfinished(records, done.select(*keys), keys)
    process(left).withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(target)
    return records.sparkSession.read.parquet(target).where(F.col("run_id") == run_id)


def summary(found: DataFrame, dimensions: list[str]) -> DataFrame:
    """AGG-06, AGG-07: documents, usable ones and quick ones, overall and by the dimensions."""
    marked = found.withColumn("speed", corpus.speed_class(F.col("status"), F.col("polygons"), F.col("fallback_used")))
    return corpus.breakdown(marked, dimensions, {"documents": F.count("*"), "usable": F.count_if(F.col("speed") != "NO_USABLE_RESULT"), "quick": F.count_if(F.col("speed") == "QUICK_USABLE")})


def sample_export(records: DataFrame, pages: DataFrame, excluded: DataFrame, size: int, seed: str, target: str) -> DataFrame:
    """ORC-10: the text-layer chain over a seeded sample of the documents that are not excluded; exports what
    passes and returns each sampled document's status."""
    free = records.join(excluded.select("doc_id"), "doc_id", "left_anti")
    chosen = free.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")), 256)).limit(size).select(F.col("doc_id").cast("string").alias("doc_id"))
    project = pipeline.run(pages.where(F.col("source_method") == "text_layer").withColumn("doc_id", F.col("doc_id").cast("string")).join(F.broadcast(chosen), "doc_id", "left_semi"))
    kml.export(project.rings, project.gate, project.reasons, target)
    marks = kml.placemarks(gate.exportable(project.rings, project.gate))
    marked = marks.groupBy("doc_id").agg(F.count("*").alias("placemarks"))
    return chosen.join(pipeline.status(project), "doc_id", "left").join(marked, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("METIN_YOK"))).na.fill(0)
