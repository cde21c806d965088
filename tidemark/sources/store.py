"""Feature store: long features in Parquet, one folder per (dataset, extractor, parameters, versions)."""

from __future__ import annotations

import hashlib
import inspect
import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregate import table_fingerprint
from tidemark.sources.tables import path_exists

# Versions of the built-in extractors; raise one when its results change.
EXTRACTOR_VERSIONS = {
    "statistics_sample": "v1.0.0",
    "statistics_population": "v1.0.0",
    "minimal": "v1.0.0",
    "compact": "v1.1.0",
    "efficient": "v1.0.0",
    "comprehensive": "v1.0.0",
    "signal_statistical": "v1.0.0",
    "signal_temporal": "v1.0.0",
}
_META = "key string, dataset string, extractor string, params string, dataset_hash string, version string, saved_at double"


def parameter_hash(params: Mapping | None) -> str:
    if not params:
        return "default"
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]


def extractor_version(extractor: str | Callable) -> str:
    """Known version, or a short hash of the name or of the source of a function."""
    if isinstance(extractor, str):
        name = extractor.lower().strip()
        return EXTRACTOR_VERSIONS.get(name) or hashlib.sha256(name.encode()).hexdigest()[:8]
    try:
        text = inspect.getsource(extractor)
    except (OSError, TypeError):
        text = getattr(extractor, "__name__", str(extractor))
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def path_fingerprint(spark: SparkSession, path: str) -> str:
    """Hash of the name, size and time of the files under a path, from the file listing."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(location):
        return hashlib.sha256(path.strip().lower().encode()).hexdigest()[:12]
    parts, files = [], system.listFiles(location, True)
    while files.hasNext():
        f = files.next()
        parts.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256(";".join(sorted(parts)).encode()).hexdigest()[:12]


def frame_fingerprint(df: DataFrame) -> str:
    """Hash of the content of a table, independent of row order and partitioning."""
    row = table_fingerprint(df).first()
    return hashlib.sha256(":".join(str(v) for v in row).encode()).hexdigest()[:12]


class FeatureStore:
    """`backend` is parquet, memory (persisted in the session) or none."""

    def __init__(self, spark: SparkSession, folder: str, backend: str = "parquet"):
        if backend not in ("parquet", "memory", "none"):
            raise ValueError(f"unknown backend {backend}")
        self.spark, self.folder, self.backend = spark, folder.rstrip("/"), backend
        self._memory: dict[str, DataFrame] = {}

    def key(
        self,
        dataset: str,
        extractor: str,
        params: Mapping | None = None,
        dataset_hash: str | None = None,
        version: str | None = None,
    ) -> str:
        parts = [n.lower().replace(" ", "_").replace("/", "_") for n in (dataset, extractor)]
        parts.append(parameter_hash(params))
        if dataset_hash is not None:
            parts.append(f"ds_{dataset_hash[:8]}")
        if version is not None:
            parts.append(f"ext_{version[:8]}")
        return "__".join(parts)

    def exists(self, dataset: str, extractor: str, params: Mapping | None = None, **provenance) -> bool:
        key = self.key(dataset, extractor, params, **provenance)
        if self.backend == "memory":
            return key in self._memory
        return self.backend == "parquet" and path_exists(self.spark, f"{self.folder}/{key}/_SUCCESS")

    def save(
        self, features: DataFrame, dataset: str, extractor: str, params: Mapping | None = None, **provenance
    ) -> str | None:
        """Write long features (sequence_id, [channel,] feature, value), clustered by feature name so
        that a read of few features skips the rest, and append a row on their origin."""
        key = self.key(dataset, extractor, params, **provenance)
        if self.backend == "none":
            return None
        if self.backend == "memory":
            self._memory[key] = features.persist()
            return None
        path = f"{self.folder}/{key}"
        features.sortWithinPartitions("feature").write.mode("overwrite").parquet(path)
        row = (
            key, dataset, extractor, json.dumps(params or {}, sort_keys=True, default=str),
            provenance.get("dataset_hash"), provenance.get("version"), time.time(),
        )
        self.spark.createDataFrame([row], _META).write.mode("append").parquet(f"{self.folder}/_metadata_log")
        return path

    def load(
        self,
        dataset: str,
        extractor: str,
        params: Mapping | None = None,
        features: Sequence[str] | None = None,
        ids: DataFrame | None = None,
        **provenance,
    ) -> DataFrame:
        """Stored features, of some names (missing ones are ignored) and some sequences only."""
        if not self.exists(dataset, extractor, params, **provenance):
            raise FileNotFoundError(self.key(dataset, extractor, params, **provenance))
        key = self.key(dataset, extractor, params, **provenance)
        df = self._memory[key] if self.backend == "memory" else self.spark.read.parquet(f"{self.folder}/{key}")
        if features is not None:
            df = df.filter(F.col("feature").isin(list(features)))
        if ids is not None:
            df = df.join(ids.select("sequence_id").distinct(), "sequence_id", "left_semi")
        return df

    def get_or_compute(
        self, dataset: str, extractor: str, compute: Callable[[], DataFrame], params: Mapping | None = None, **provenance
    ) -> tuple[DataFrame, bool]:
        """The stored features and True, or the computed ones (stored on the way) and False."""
        if self.exists(dataset, extractor, params, **provenance):
            return self.load(dataset, extractor, params, **provenance), True
        features = compute()
        if self.backend == "none":
            return features, False
        self.save(features, dataset, extractor, params, **provenance)
        return self.load(dataset, extractor, params, **provenance), False

    def metadata(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/_metadata_log")

    def clear(self, dataset: str | None = None) -> None:
        """Delete the stored features, all or those of one dataset."""
        prefix = "" if dataset is None else dataset.lower().replace(" ", "_").replace("/", "_") + "__"
        for key in [k for k in self._memory if k.startswith(prefix)]:
            self._memory.pop(key).unpersist()
        if self.backend != "parquet" or not path_exists(self.spark, self.folder):
            return
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.listStatus(root):
            name = status.getPath().getName()
            if name.startswith(prefix) and not name.startswith("_"):
                system.delete(status.getPath(), True)
