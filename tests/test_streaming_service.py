import json
import threading
import urllib.request

import pytest

from sparkdex.service import Service, serve
from sparkdex.streaming.feed import feed_table


def test_stream_feeds_a_table_once(engine, spark, tmp_path):
    engine.sql("CREATE TABLE t (k INT INDEX BTREE, v VARCHAR[9])")
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(src)
    read = lambda: spark.readStream.schema("k int, v string").parquet(src)
    feed_table(engine, "t", read(), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(2, "c")], "k int, v string").write.mode("append").parquet(src)
    feed_table(engine, "t", read(), str(tmp_path / "cp")).awaitTermination()
    assert engine.sql("SELECT v FROM t WHERE k = 2")[0].rows() == [["b"], ["c"]]
    (stream,) = engine.catalog.load("t").streams
    assert engine.insert_frame("t", engine.table("t"), (stream, 0)) == 0  # a batch seen before


def test_streams_do_not_drop_each_others_batches(engine, spark, tmp_path):
    engine.sql("CREATE TABLE t (k INT, v VARCHAR[9])")
    for n in range(3):
        src = str(tmp_path / f"in{n}")
        spark.createDataFrame([(n, "a"), (n, "b")], "k int, v string").repartition(2).write.parquet(src)
        read = spark.readStream.schema("k int, v string").option("maxFilesPerTrigger", 1).parquet(src)
        feed_table(engine, "t", read, str(tmp_path / f"cp{n}")).awaitTermination()
    assert engine.table("t").count() == 6 and len(engine.catalog.load("t").streams) == 3
    # the same source from a new checkpoint is read again, whole
    feed_table(engine, "t", spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in0")), str(tmp_path / "other")).awaitTermination()
    assert engine.table("t").count() == 8


def test_service_over_http(engine):
    s = Service(engine)
    assert s.upload_csv("p", "p.csv", b"id,name\n1,Ana\n2,Luis\n") == {"ok": True, "inserted": 2}
    with pytest.raises(ValueError):
        s.upload_csv("p", "p.txt", b"")
    with pytest.raises(ValueError):
        s.run_sql("SELECT * FROM p WHERE name <-> 'x.png'")
    with pytest.raises(ValueError):
        s.sql_with_file("SELECT * FROM p", "x.png", b"")
    server = serve(s, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    get = lambda p: json.load(urllib.request.urlopen(base + p))
    assert get("/api/tables") == ["p"]
    assert b"<textarea" in urllib.request.urlopen(base + "/").read()
    assert get("/api/tables/p/schema")["schema"] == [["id", "INT", None], ["name", "VARCHAR", 4]]
    req = urllib.request.Request(base + "/api/sql", json.dumps({"query": "CREATE INDEX i ON p(id) TYPE HASH; SELECT name FROM p WHERE id = 2"}).encode())
    out = json.load(urllib.request.urlopen(req))
    assert out["results"][1] == {"ok": True, "columns": ["name"], "rows": [["Luis"]], "used_index": {"column": "id", "type": "EHASH"}}
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(urllib.request.Request(base + "/api/sql", b'{"query": "SELECT"}'))
    assert e.value.code == 400
    server.shutdown()
