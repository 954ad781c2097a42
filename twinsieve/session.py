"""Where Python workers find this package, and where tables are kept between steps."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Put the folder that holds the package on the workers' path, beside what is there already.

    Unions are not planned as if they kept their inputs' partitions: adaptive execution may
    coalesce one input and not the other, and such a union then fails to zip them.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
    return spark


def settle(df: DataFrame, **options) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir and read again, which cuts its lineage.

    Unlike checkpoint(), the new plan takes size and partitions from the files, so that loops
    do not square an estimate each round. Where the setting is unset, as in tests on one
    machine, a folder of the warehouse is used. `drop` deletes the files. Options are the writer's.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/twinsieve-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a settled table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
