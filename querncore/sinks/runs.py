"""Run folders: results, summary, failures, assets stored once by their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(results: DataFrame, summary: DataFrame, failures: DataFrame, path: str, config: DataFrame | None = None) -> None:
    """One folder a run: results and summary as JSON lines, failures as CSV (quotes doubled). Spark's committer publishes whole files."""
    results.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")
    failures.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/failures")
    if config is not None:
        config.write.mode("overwrite").json(f"{path}/config")


def store_assets(assets: DataFrame, path: str, content: str = "bytes") -> DataFrame:
    """Adds assets that the store does not hold yet, one for each content, partitioned by the first two digits of the hash. Returns what was added."""
    spark = assets.sparkSession
    new = assets.withColumn("content_hash", F.sha2(F.col(content), 256)).dropDuplicates(["content_hash"]).withColumn("prefix", F.left("content_hash", F.lit(2)))
    held = _held(spark, path)
    if held is not None:
        new = new.join(held, "content_hash", "left_anti")
    added = new.select("content_hash", "prefix", F.col(content).alias("bytes"))
    added.write.mode("append").partitionBy("prefix").parquet(path)
    return added.select("content_hash")


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path).select("content_hash") if fs.exists(jpath) else None


def write_shards(rows: DataFrame, path: str, *by: str) -> None:
    """Shard files: a folder for each split and shard."""
    rows.repartition(*by).write.mode("overwrite").partitionBy(*by).json(path)


def merge_by_key(base: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """Upsert: new rows replace those with their key. A key that new repeats is an error, before anything is written."""
    from querncore.operators.joins import upsert

    twice = new.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} occurs more than once: {[r[0] for r in twice]}")
    upsert(base, new, key).write.mode("errorifexists").parquet(path)


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    got = rows.limit(limit).collect()
    head = rows.columns
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([f"# {title}", "", line(head), line(["---"] * len(head)), *(line(r) for r in got), ""])
