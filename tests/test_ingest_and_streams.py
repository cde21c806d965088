"""Raw files to pairs, and features of arriving data."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ingest, tables
from tidemark.streaming.features import latest_features, stream_sequence_features, windowed_statistics


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def machine_csv(tmp_path, n=60):
    head = "UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],Tool wear [min],Machine failure,TWF,HDF,PWF,OSF,RNF"
    rows = [f"{i + 1},M{i},{'LMH?'[i % 4]},{300 + i},310,{1500 + i},40.5,{i},{int(i % 20 == 19)},0,0,0,0,0" for i in range(n)]
    return write(tmp_path / "log.csv", "\n".join([head, *rows]))


def test_machine_log(spark, tmp_path):
    sequences, targets = ingest.ingest_machine_log(spark, machine_csv(tmp_path), 20)
    assert [r.target for r in targets.orderBy("sequence_id").collect()] == [1, 1, 1]
    assert not set(ingest.LEAK_COLUMNS) & set(sequences.columns)
    kinds = [r.Type for r in sequences.filter("sequence_id = 0").orderBy("step").limit(4).collect()]
    assert kinds == [0.0, 1.0, 2.0, None]
    assert ingest.ingest_machine_log(spark, machine_csv(tmp_path), windowed=False).filter("id = 1").count() == 60


def test_channel_log_fills_gaps(spark, tmp_path):
    head = ",".join(["y", *[f"X{i}" for i in range(1, 17)]])
    rows = [",".join([str(i // 10), "" if i % 3 == 0 else "NaN" if i % 3 == 1 else str(i), *["1.5"] * 15]) for i in range(40)]
    sequences, targets = ingest.ingest_eeg(spark, write(tmp_path / "eeg.csv", "\n".join([head, *rows])), 10)
    assert [r.target for r in targets.orderBy("sequence_id").collect()] == [0, 1, 2, 3]
    assert [r.X1 for r in sequences.filter("sequence_id = 0").orderBy("step").collect()] == [0, 0, 2, 0, 0, 5, 0, 0, 8, 0]


def test_air_quality_fills_both_ways(spark, tmp_path):
    head = "pm2.5,cbwd,DEWP,TEMP,PRES,Iws,Is,Ir"
    levels = ["NA", "NA", "4", "NA", "8", "NA"]
    rows = [f"{v},{('NW', 'cv')[i % 2]},1,2,3,4,5,6" for i, v in enumerate(levels)]
    sequences, targets = ingest.ingest_air_quality(spark, write(tmp_path / "air.csv", "\n".join([head, *rows])), 3)
    assert [r.target for r in targets.orderBy("sequence_id").collect()] == [4.0, (4 + 8 + 8) / 3]
    assert {"cbwd_NW", "cbwd_cv"} <= set(sequences.columns)


def test_activity_without_subjects(spark, tmp_path):
    for split, n in (("train", 3), ("test", 2)):
        write(tmp_path / split / f"y_{split}.txt", "\n".join(str(i + 1) for i in range(n)))
        for s in ("a", "b"):
            write(tmp_path / split / "Inertial Signals" / f"{s}_{split}.txt", "\n".join(f"  {i}.5   {i}e0 " for i in range(n)))
    sequences, targets = ingest.ingest_activity(spark, str(tmp_path), ["a", "b"])
    assert sequences.count() == 10 and targets.orderBy("sequence_id").collect()[3].target == 1
    assert "subject_id" not in targets.columns


def test_sparse_batches_in_number_order(spark, tmp_path):
    write(tmp_path / "batch1.dat", "1;1.0 1:0.5 2:1.2\n2;1.0 4:7\n")
    write(tmp_path / "batch2.dat", "3;1.0 3:9\n")
    write(tmp_path / "batch10.dat", "4;1.0 1:1\n")
    sequences, targets = ingest.ingest_gas_sensors(spark, str(tmp_path), width=4, steps=2)
    assert [(r.target, r.batch) for r in targets.orderBy("sequence_id").collect()] == [(1, 1), (2, 1), (3, 2), (4, 10)]
    first = {(r.sequence_id, r.step): (r.sensor_0, r.sensor_1) for r in sequences.collect()}
    assert first[0, 0] == (0.5, 1.2) and first[1, 1] == (0.0, 7.0) and first[2, 1] == (9.0, 0.0)


def test_delimited_options(spark, tmp_path):
    path = write(tmp_path / "w.txt", "name  size\n a   1,200 \n b  x\n")
    rows = ingest.read_delimited(spark, path, sep=r"\s+", thousands=",", numeric=["size"]).orderBy("name").collect()
    assert [(r.name, r["size"]) for r in rows] == [("a", 1200.0), ("b", None)]


def test_load_by_name(spark, tmp_path):
    raw = machine_csv(tmp_path, 400)
    tables.load_dataset(spark, "pred-maintenance", raw, str(tmp_path / "stored"))
    assert tables.load_dataset(spark, "pred-maintenance", None, str(tmp_path / "stored"))[1].count() == 2
    with pytest.raises(KeyError):
        tables.load_dataset(spark, "absent", raw, str(tmp_path))


def test_stream_of_sequences_is_written_once(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 6).alias("sequence_id"), F.floor(F.col("id") / 6).cast("int").alias("step"), F.col("id").cast("double").alias("v"))
    df.repartition(3, "sequence_id").write.parquet(str(tmp_path / "in"))
    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream_sequence_features(stream, str(tmp_path / "out"), str(tmp_path / "log"), channels=["v"]).awaitTermination()
        return latest_features(spark.read.parquet(str(tmp_path / "out")))

    first = run()
    assert first.count() == 6 * 5
    assert run().count() == 30
    assert first.filter("sequence_id = 1 AND feature = 'v__max'").first().value == 55.0


def test_time_windows_with_late_rows(spark, tmp_path):
    rows = [("u", 10, 1.0), ("u", 50, 3.0), ("u", 70, 5.0), ("u", 400, 7.0)]
    df = spark.createDataFrame(rows, "user string, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    late = spark.createDataFrame([("u", 20, 100.0), ("u", 500, 1.0)], "user string, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    batch = {r.window_start.minute: r for r in windowed_statistics(df, "ts", ["user"], ["v"], "1 minute").collect()}
    assert batch[0].n_rows == 2 and batch[0].v__mean == 2.0 and batch[0].v__energy == 10.0
    source, sink = str(tmp_path / "in"), "late_windows"
    df.coalesce(1).write.parquet(source)
    def run():
        stream = windowed_statistics(spark.readStream.schema(df.schema).parquet(source), "ts", ["user"], ["v"], "1 minute", lateness="30 seconds")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()

    run()
    late.coalesce(1).write.mode("append").parquet(source)
    run()
    closed = {r.window_start.minute: r.n_rows for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The row of second 20 came after its window was closed.
    assert closed[0] == 2 and closed[1] == 1
    assert sink
