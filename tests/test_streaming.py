from webloom.sources.sinks import TableSink
from webloom.streaming.twins import limit, new_urls, save


def batches(spark, folder, schema, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(stream, spark, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_limit(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", "bucket string, arrival double, seq bigint", [("a", 0.0, 0), ("a", 0.0, 1), ("b", 0.0, 2)], [("a", 0.5, 3), ("a", None, 4)])
    got = sorted((r["bucket"], r["seq"], r["start_us"]) for r in drain(limit(stream, 1.0), spark, "limited", tmp_path).collect())
    assert got == [("a", 0, 0), ("a", 1, 1_000_000), ("a", 3, 2_000_000), ("b", 2, 0)]


def test_new_urls_and_upsert(spark, tmp_path):
    schema = "url string, crawled_at string"
    stream = batches(spark, tmp_path / "in", schema, [("u", "1"), ("v", "1")], [("u", "2")])
    assert sorted(r["url"] for r in drain(new_urls(stream), spark, "urls", tmp_path).collect()) == ["u", "v"]
    save(stream, TableSink(str(tmp_path / "table")), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect())) == [("u", "2"), ("v", "1")]
