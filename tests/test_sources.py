import json

from docweave import hooks
from docweave.sources import readers, writers
from docweave.streaming import ingest
from pyspark.sql import functions as F


def test_text_files_fall_back_to_latin_1(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\u00e9 \u0110i\u1ec1u".encode())
    (tmp_path / "b.txt").write_bytes("caf\u00e9".encode("latin-1"))
    got = [r["text"] for r in readers.read_text_files(spark, str(tmp_path)).orderBy("path").collect()]
    assert got == ["caf\u00e9 \u0110i\u1ec1u", "caf\u00e9"]


def test_json_arrays_get_plain_names(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"recall@1": 0.5, "bleu-4": 1.0}, {"recall@1": 1.0, "bleu-4": None}]))
    df = readers.read_json_records(spark, str(path))
    assert sorted(df.columns) == ["bleu_4", "recall_at_1"] and df.count() == 2


def test_csv_rows_become_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,y\n")
    assert sorted(r["line"] for r in readers.read_csv_as_text(spark, str(tmp_path / "t.csv")).collect()) == ["1 x", "NaN y"]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'say "x"')], "id long, t string")
    for fmt in ("json", "csv"):
        writers.write_results(df, str(tmp_path / fmt), fmt)
    back = spark.read.option("escape", '"').csv(str(tmp_path / "csv"), header=True, schema="id long, t string")
    assert spark.read.schema("id long, t string").json(str(tmp_path / "json")).count() == 2 and back.count() == 2


def test_small_inputs_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert readers.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    assert readers.spread(spark.range(10, numPartitions=cores + 3)).rdd.getNumPartitions() == cores + 3


def docs(spark, first, n):
    return spark.range(first, first + n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Some words of document number "), F.col("id").cast("string"), F.lit(". More words follow here.")).alias("text"))


def test_stream_appends_each_document_once(spark, tmp_path):
    source, target, offsets = (str(tmp_path / n) for n in ("in", "out", "off"))
    for first in (0, 10):
        docs(spark, first, 10).write.mode("append").parquet(source)
        ingest.ingest_stream(spark, source, target, offsets, 4, 1).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(target).collect()))
    assert got == sorted(map(tuple, ingest.window_chunks(docs(spark, 0, 20), 4, 1).collect()))


def test_keys_come_back_after_their_time(spark, tmp_path):
    source, target, offsets = (str(tmp_path / n) for n in ("in", "out", "off"))
    schema = "key string, ts timestamp"
    for key, hour in (("a", "10:00"), ("a", "10:10"), ("b", "11:30"), ("a", "12:00"), ("a", "12:05")):
        spark.sql(f"select '{key}' as key, timestamp '2024-01-01 {hour}:00' as ts").write.mode("append").parquet(source)
        once = ingest.dedupe_stream(spark.readStream.schema(schema).parquet(source), 1800)
        once.writeStream.format("parquet").option("path", target).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r["t"] for r in spark.read.parquet(target).select(F.date_format("ts", "HH:mm").alias("t")).collect())
    assert got == ["10:00", "11:30", "12:00"]


def test_keys_come_back_within_one_batch(spark, tmp_path):
    source, target, offsets = (str(tmp_path / n) for n in ("in", "out", "off"))
    hours = ("12:05", "10:00", "12:00", "10:10", "10:30", "10:31")
    rows = " union all ".join(f"select 'a' as key, timestamp '2024-01-01 {h}:00' as ts" for h in hours)
    spark.sql(rows).write.parquet(source)
    once = ingest.dedupe_stream(spark.readStream.schema("key string, ts timestamp").parquet(source), 1800)
    once.writeStream.format("parquet").option("path", target).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r["t"] for r in spark.read.parquet(target).select(F.date_format("ts", "HH:mm").alias("t")).collect())
    assert got == ["10:00", "10:31", "12:00"]


def test_keys_of_one_group_keep_their_own_times(spark, tmp_path):
    """All keys in one group, over several batches, a missing key among them."""
    source, target, offsets = (str(tmp_path / n) for n in ("in", "out", "off"))
    schema = "key string, ts timestamp"
    batches = [(("a", "10:00"), ("b", "10:20"), (None, "10:20")), (("a", "10:25"), ("b", "10:51"), ("c", "10:52"), (None, "10:40")), (("c", "11:30"), ("a", "11:31"))]
    for rows in batches:
        made = spark.createDataFrame([(k, f"2024-01-01 {h}:00") for k, h in rows], "key string, ts string")
        made.select("key", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        once = ingest.dedupe_stream(spark.readStream.schema(schema).parquet(source), 1800, groups=1)
        once.writeStream.format("parquet").option("path", target).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    got = {(r["key"], r["t"]) for r in spark.read.parquet(target).select("key", F.date_format("ts", "HH:mm").alias("t")).collect()}
    assert got == {("a", "10:00"), ("b", "10:20"), (None, "10:20"), ("b", "10:51"), ("c", "10:52"), ("c", "11:30"), ("a", "11:31")}


def test_running_counts_keep_the_newest_batch(spark, tmp_path):
    source, target, offsets = (str(tmp_path / n) for n in ("in", "out", "off"))
    schema = "conv_id long, ts timestamp, role string"
    for minute in (1, 2):
        spark.sql(f"select 1L as conv_id, timestamp '2024-01-01 10:0{minute}:00' as ts, 'user' as role").write.mode("append").parquet(source)
        stream = ingest.conversation_stream(spark.readStream.schema(schema).parquet(source))
        ingest.upsert_batches(stream, target, offsets).awaitTermination()
    rows = spark.read.parquet(target).filter("messages is not null").orderBy(F.desc("batch")).select("messages").collect()
    assert rows[0]["messages"] == 2


def test_model_is_loaded_once_per_task(spark):
    def make():
        seen = []

        def model(texts):
            seen.append(1)
            return [[float(len(t)), float(len(seen))] for t in texts]

        return model

    df = spark.createDataFrame([(i, "x" * i) for i in range(4)], "id long, text string").coalesce(1)
    got = [r["embedding"] for r in hooks.embed(df, make).orderBy("id").collect()]
    assert [v[0] for v in got] == [0.0, 1.0, 2.0, 3.0]
