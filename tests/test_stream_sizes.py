import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.plans import feature_queries as Q
from tidemark.plans.registry import QUERIES
from tidemark.streaming import count_windows

SMALL = "/root/testdata/sf0.001"


def test_files_of_a_stream_hold_few_rows(spark, small_tasks, tmp_path, monkeypatch):
    spark.conf.set("spark.tidemark.maxGroupRows", "1000")
    monkeypatch.setattr(Q, "scratch_folder", lambda _: str(tmp_path))
    out = QUERIES["streamed_sequence_features"](spark, SMALL)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    assert out.count() == 2 * lines.select("l_suppkey").distinct().count()
    files = spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 2 and len(list((tmp_path / "out").glob("batch=*"))) == 2
    assert sum(r["count"] for r in files) == lines.count()


def test_arrays_sort_as_frames_do():
    rng = np.random.default_rng(6)
    x = np.where(rng.random(40) < 0.2, np.nan, rng.integers(0, 4, 40))
    for y in (rng.integers(0, 3, 40), np.array([f"k{v}" if v else None for v in rng.integers(0, 3, 40)], dtype=object)):
        rows = {"x": x, "y": y, "i": np.arange(40)}
        expected = pd.DataFrame(rows).sort_values(["x", "y"], kind="stable")["i"].tolist()
        assert count_windows._in_order(rows, ["x", "y"])["i"].tolist() == expected
