"""What the operators share: the shared folder, written stages, identifiers, range buckets."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; the pattern is Java's and Python's.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set and all runs on one machine (tests), one is made and set; a
    cluster without one is an error, since its machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="querncore-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/querncore-{name}-{uuid.uuid4().hex}"


#: Paths written inside each ``scratch`` that is open.
_scopes: list[list[str]] = []


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: cuts the lineage in a way that outlives executors."""
    path, schema, spark = new_path(df.sparkSession, name), df.schema, df.sparkSession
    df.write.parquet(path, compression=codec)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside go when it closes, but for the last one: the result."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop()[:-1]:
            _delete(spark, path)


def removed(*tables: DataFrame) -> None:
    """Removes the folders of tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/querncore-" in folder:
                _delete(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Has the session hand at most ROWS rows to Python at once, as a user would set it: a batch of the usual 10,000 whole texts or packed blocks is held by
    the JVM and by Python at the same time. Rows that come later are handed over the same way."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def id_crc(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text (a null id: of the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_points(df: DataFrame, col: str, buckets: int) -> np.ndarray:
    """At most buckets - 1 ascending values that part the column into about equal ranges. Reads that column alone; what reaches
    the driver is bounded by the number of buckets."""
    probs = [i / buckets for i in range(1, buckets)]
    if not probs:
        return np.array([], dtype=np.int64)
    got = df.agg(F.percentile_approx(F.col(col), F.array(*map(F.lit, probs)), F.lit(max(10_000, 20 * buckets)))).first()[0]
    return np.unique(np.array([x for x in got or [] if x is not None], dtype=np.int64))


def bucket_of(points: np.ndarray):
    """Column -> Column: the range that a value falls in, larger values in later ranges; a null in range 0."""

    @F.pandas_udf("int")
    def find(v: pd.Series) -> pd.Series:
        at = np.searchsorted(points, v.fillna(0).to_numpy(dtype=np.int64), side="right") if v.dtype != np.int64 else np.searchsorted(points, v.to_numpy(), side="right")
        return pd.Series(np.where(v.isna(), 0, at).astype(np.int32))

    return find


#: Steps of frequency in a doubling.
STEPS = 64


def most_frequent(counts: DataFrame, count: str, limit: int) -> tuple[pa.Table, Column]:
    """At most ``limit`` rows with the largest counts (1 and more), and the condition that holds for exactly these. No sort: rows are told apart by
    steps of their count's logarithm, and how many rows each step has (some thousand numbers at any size) tells where to stop."""
    step = F.floor(F.log2(F.col(count)) * STEPS)
    sizes = counts.filter(F.col(count) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n"))
    least, rows = 1 << 31, 0
    for s, n in sorted(((r[0], r[1]) for r in sizes.collect()), reverse=True):
        if rows + n > limit:
            break
        least, rows = s, rows + n
    chosen = (F.col(count) > 0) & (step >= least)
    return counts.filter(chosen).toArrow(), chosen


def row_key(df: DataFrame) -> list[Column]:
    """Columns _k1 long and _k2 int that tell rows apart by all that they hold: rows with the same key are the same row, repeated. They depend on the
    row alone, so a row read twice, or again after an executor was lost, has the same key. Columns of maps, which have no order, do not count."""
    fields = [f for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    held = [F.col(f"`{f.name}`") for f in fields]
    nulls = F.array(*(c.isNull() for c in held))
    return [F.xxhash64(nulls, *held).alias("_k1"), F.hash(nulls, *held).alias("_k2")]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
