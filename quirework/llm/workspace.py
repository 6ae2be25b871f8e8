"""Written intermediate tables in the folder that all executors share.

A table cuts the lineage: what reads it never runs the steps before it again,
so results of a task (partition numbers, running counters) stay fixed when an
executor is lost later.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode a folder of our own where it is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quirework-")
    context.setCheckpointDir(root)
    return root


#: Bytes of (compressed) input for each partition of a sort.
PARTITION = 64 << 20


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of all of df: by the bytes of the tables that it reads, the session's number at least.

    A table whose size isn't known doesn't count.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(least, -(-sum(x for x in sizes if x < 1 << 60) // PARTITION))


class Workspace:
    """One folder of written tables. ``drop`` or ``clear`` removes what later steps don't read.

    An operator's result reads its tables; whoever has written or collected
    the result clears the workspace that was given to the operator.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/tables-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        options = {"compression": "zstd"} | options
        df.write.options(**options).parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
