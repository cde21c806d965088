"""Session defaults, size limits and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of one group that a single task may sort or buffer.
MAX_GROUP_ROWS = ("spark.tidemark.maxGroupRows", 1_000_000)
# Rows of one block of a long sequence.
BLOCK_ROWS = ("spark.tidemark.blockRows", 65_536)
# Rows a table may have to be broadcast or collected on the driver.
MAX_SMALL_ROWS = ("spark.tidemark.maxSmallRows", 100_000)


def build_session(app: str = "tidemark", cpus: str = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def limit(spark: SparkSession, setting: tuple[str, int]) -> int:
    name, default = setting
    return int(spark.conf.get(name, str(default)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for local runs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and read them from there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one piece of work, in the shared checkpoint folder. They go when they are dropped, the rest when the
    work is done; what has to outlive it is written with `cut_lineage`.

        with Scratch(spark) as scratch:
            a = scratch.cut(df)
            result = cut_lineage(a.join(...))
    """

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)

    def cut(self, df: DataFrame, *instead: DataFrame) -> DataFrame:
        """Write the rows once and read them from there; tables that were only needed for them go."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((written, path))
        self.drop(*instead)
        return written

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for t, p in self.tables if any(t is x for x in tables)]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def require_small(df: DataFrame, what: str) -> int:
    """Row count of a table meant for broadcast or the driver; raise if it has outgrown that."""
    cap = limit(df.sparkSession, MAX_SMALL_ROWS)
    rows = df.limit(cap + 1).count()
    if rows > cap:
        raise ValueError(f"{what} has more than {cap} rows")
    return rows
