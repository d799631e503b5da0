"""Where intermediate tables go: the folder that the driver and all executors share, and in how many files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests), a local one that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths given out so far, for ``drop_made``.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/loomlog/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def made() -> int:
    """How many paths have been given out: a mark for ``drop_made``."""
    return len(_made)


def drop_made(spark: SparkSession, since: int) -> None:
    """Delete what lies at the paths given out since a mark: once a result that was worked out from them is written."""
    for path in _made[since:]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    del _made[since:]


def tasks(spark: SparkSession, partitions: int) -> int:
    """Tasks that write a table of so many partitions: four for each core of the cluster, or as many as make eight partitions a task where that is more. A file per partition would mean mostly tiny files."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-partitions // 8), 1)


def partitions_of(docs: DataFrame) -> int:
    """Partitions of a table as it is read; of one that shuffles make, those that a shuffle makes (counting would run it)."""
    plan = docs._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getSimpleName():
        return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs._jdf.queryExecution().toRdd().getNumPartitions()


def settle(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` in ``tasks`` partitions at most; ``partitions``: those it has, by default those that a shuffle makes."""
    spark = df.sparkSession
    return df.coalesce(tasks(spark, int(spark.conf.get("spark.sql.shuffle.partitions")) if partitions is None else partitions))


def materialize(df: DataFrame, name: str, partitions: int | None = None, **options: object) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, settled and with these options, and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    settle(df, partitions).write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 8 MB at most, where the session has Spark's default of 64 MB: texts are long, and every Python step of a task has batches of its own in the JVM and in Python. The setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == "67108864b":
        spark.conf.set(name, "8m")
