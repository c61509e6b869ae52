"""Relations as tables in the shared folder: written once, read by later rounds, so lineage stays short and the loss of an
executor costs one read."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import ProgramError


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset a temporary folder of this machine serves, if
    the session runs on this machine alone; on a cluster it would not be shared, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ProgramError("E0801", "spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "facteng-checkpoints")
    return root.rstrip("/")


class Tables:
    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/relations-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The table of df and its number of rows, by one job."""
        self.n += 1
        path, seen = f"{self.root}/{self.n:05d}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), int(seen.get["n"])

    def delete(self) -> None:
        """Removes every table; results that were not written elsewhere are lost."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
