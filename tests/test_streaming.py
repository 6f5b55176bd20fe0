from lakeveil.plans import queries
from lakeveil.streaming import detect as stream


def test_stream_equals_table(spark, small_dir, tmp_path):
    p = queries.document_pages(spark, small_dir)
    p.repartition(3, "page_no").write.parquet(str(tmp_path / "in"))
    q = stream.detections(stream.read_pages(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, stream.detections(p).collect()))


def test_registry_grows_by_batch(spark, tmp_path):
    path, schema = str(tmp_path / "registry"), "container string, page_no bigint, start bigint, entity_type string, value string"
    grow = stream.grow(spark, path)
    first = spark.createDataFrame([("c", 1, 0, "person", "A a"), ("c", 2, 0, "person", "B b")], schema)
    later = spark.createDataFrame([("c", 3, 0, "person", "a A"), ("c", 4, 0, "person", "C c"), ("d", 1, 0, "person", "A a")], schema)
    grow(first, 0)
    grow(later, 1)
    grow(later, 1)  # done again after a failure
    rows = spark.read.parquet(path)
    assert sorted((r.container, r.placeholder, r.original) for r in rows.collect()) == [("c", "PERSON_001", "A a"), ("c", "PERSON_002", "B b"), ("c", "PERSON_003", "C c"), ("d", "PERSON_001", "A a")]
