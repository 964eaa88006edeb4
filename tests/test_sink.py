import json
import shutil

import pytest
from pyspark.sql import functions as F

from vektorium.streaming import sink


def rows(df):
    return sorted((r["event_id"], r["status"], r["response"]) for r in df.collect())


def answers(spark, ids):
    return spark.createDataFrame([(i, 200 if i % 2 else 404, f'{{"n":"ü{i}"}}' if i % 2 else None) for i in ids], "event_id long, status int, response string").repartition(3)


def test_batches_are_there_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "LINES", 4)
    path = str(tmp_path / "out")
    assert rows(sink.read_responses(spark, path)) == []
    for batch, ids in ((0, range(30)), (1, range(30, 45)), (1, range(30, 45)), (0, range(30)), (2, range(0))):
        sink.write_responses(answers(spark, ids), path, batch)
    assert rows(sink.read_responses(spark, path)) == rows(answers(spark, range(45)))
    listed = [n for f in (tmp_path / "out/batches").glob("*.json") for n in json.loads(f.read_text())["files"]]
    assert sorted(listed) == sorted(f"files/{f.name}" for f in (tmp_path / "out/files").glob("*.json"))  # what was written again has gone


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = answers(spark, range(40)).withColumn("response", F.when(F.col("event_id") == 33, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("response")))
    with pytest.raises(Exception, match="broken row"):
        sink.write_responses(bad, path, 5)
    assert rows(sink.read_responses(spark, path)) == [] and not (tmp_path / "out/batches").exists()
    sink.write_responses(answers(spark, range(40)), path, 5)
    assert sink.read_responses(spark, path).count() == 40


def test_a_replayed_stream_writes_once(spark, tmp_path):
    """Spark loses its note that a micro-batch was done, and writes it again: each response is there once."""
    spark.dataSource.register(sink.Responses)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema("event_id long, status int, response string").option("maxFilesPerTrigger", 1).json(source)
        stream.writeStream.format("responses").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    answers(spark, range(20)).coalesce(1).write.json(source)
    run()
    answers(spark, range(20, 35)).coalesce(1).write.mode("append").json(source)
    run()
    commits = sorted((tmp_path / "checkpoint/commits").glob("[0-9]*"))
    for f in (tmp_path / "checkpoint/commits").iterdir():  # the last micro-batch's note, and its checksum
        if f.name in (commits[-1].name, f".{commits[-1].name}.crc"):
            f.unlink()
    run()
    assert rows(sink.read_responses(spark, path)) == rows(answers(spark, range(35)))
    shutil.rmtree(source)
