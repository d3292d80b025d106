"""Where tables go that driver and executors share, and how small ones are spread."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; without that setting, below a temporary
    folder of this machine that goes when the process ends. The latter is for local mode alone:
    executors elsewhere would not see it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lectern/{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table in as many partitions as there are cores, at least: a file of one row group would
    keep all but one of them idle. A large table has more partitions, and nothing moves; nor do rows that
    come from a shuffle."""
    plan, cores = rows._jdf.queryExecution(), rows.sparkSession.sparkContext.defaultParallelism
    shuffled = plan.executedPlan().nodeName() == "AdaptiveSparkPlan"
    return rows if shuffled or plan.toRdd().getNumPartitions() >= cores else rows.repartition(cores)


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle, for a right side that grows with the input. The estimate of a table's size is that of its
    packed files, which for columns that repeat is far below its rows; left to itself, Spark broadcasts such tables through the driver."""
    return left.join(right.hint("merge"), on, how)


def written(rows: DataFrame, at: str | None = None) -> DataFrame:
    """Rows, once computed: a table in the shared folder. Ends a plan that many steps look at."""
    at = at or shared_dir(rows.sparkSession)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
