from tesela.session import Engine
from tesela.streaming.ingest import stream_into


def test_stream_and_bulk_append(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "w"))
    (tmp_path / "c.csv").write_text("Country,City,Latitude,Longitude\nes,a,0,1\n")
    assert engine.sql(f'CREATE TABLE C FROM FILE "{tmp_path}/c.csv" USING INDEX rtree(Latitude, Longitude)').status == 200
    schema = "Country string, City string, Latitude string, Longitude string"
    more = spark.createDataFrame([("es", "a", "2", "2"), ("es", "b", "99", "2"), ("es", "c", "x", "2")], schema)
    assert engine.bulk_append("C", more) == 1 and engine.count("C") == 2
    more.limit(1).write.parquet(str(tmp_path / "in"))
    q = stream_into(engine, "C", spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert engine.count("C") == 3
    assert engine.bulk_append("C", more, stream=str(tmp_path / "ck"), batch=0) == 0 and engine.count("C") == 3  # a batch that runs again
    assert engine.bulk_append("C", more, stream=str(tmp_path / "ck"), batch=1) == 1 and engine.count("C") == 4
    assert engine.sql("INSERT INTO C VALUES (es, z, 5, 5)").status == 200 and engine.count("C") == 5
