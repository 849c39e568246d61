import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from sparkdex.functions.types import SchemaError
from sparkdex.plans import ast
from sparkdex.plans.engine import EngineError
from sparkdex.plans.parser import ParseError
from sparkdex.sources.catalog import CatalogError

KINDS = ["BTREE", "HASH", "ISAM", "SEQ"]


def rows(engine, sql):
    return engine.sql(sql)[-1].rows()


def used(engine, sql):
    return (engine.sql(sql)[-1].used_index or {}).get("type")


def test_people_from_csv_with_btree_and_hash(engine, write):
    engine.load_csv("personas", write("p.csv", "Nombre,Edad\nAna,30\nLuis,25\nAna,40\n"))
    assert [c[1:] for c in engine.catalog.load("personas").columns] == [["VARCHAR", 4], ["INT", None]]
    engine.sql("CREATE INDEX a ON personas(Edad) TYPE BTREE; CREATE INDEX b ON personas(Nombre) TYPE HASH")
    assert rows(engine, "SELECT * FROM personas WHERE Edad BETWEEN 26 AND 39") == [["Ana", 30]]
    assert rows(engine, "SELECT * FROM personas WHERE Edad = 30") == [["Ana", 30]]
    assert rows(engine, "SELECT Edad FROM personas WHERE Nombre = 'Ana'") == [[30], [40]]
    assert used(engine, "SELECT * FROM personas WHERE Edad = 30") == "BTREE"
    assert used(engine, "SELECT * FROM personas WHERE Nombre = 'Ana'") == "EHASH"
    engine.sql("INSERT INTO personas VALUES ('Carla', 35)")  # stored as Carl
    assert rows(engine, "SELECT * FROM personas WHERE Nombre = 'Carla'") == [["Carl", 35]]
    assert rows(engine, "SELECT * FROM personas WHERE Edad BETWEEN 31 AND 36") == [["Carl", 35]]
    assert engine.sql("DELETE FROM personas WHERE Nombre = 'Ana'")[0].info == {"deleted": 2}
    assert rows(engine, "SELECT Nombre FROM personas") == [["Luis"], ["Carl"]]
    assert rows(engine, "SELECT * FROM personas WHERE Edad = 30") == []


def test_hash_email(engine, write):
    engine.load_csv("h_users", write("h.csv", "Usuario,Email\nu1,a@mail\nu2,b@mail\nu3,a@mail\n"))
    engine.sql("CREATE INDEX i ON h_users(Email) TYPE HASH")
    assert rows(engine, "SELECT Usuario FROM h_users WHERE Email = 'a@mail'") == [["u1"], ["u3"]]
    engine.sql("INSERT INTO h_users VALUES ('u4','a@mail')")
    assert rows(engine, "SELECT Usuario FROM h_users WHERE Email = 'a@mail'") == [["u1"], ["u3"], ["u4"]]
    assert used(engine, "SELECT * FROM h_users WHERE Email BETWEEN 'a' AND 'b'") is None


def test_isam_and_seq_tables(engine, write):
    engine.load_csv("t_isam", write("i.csv", "Id,Edad\n1,21\n2,30\n3,33\n4,40\n5,45\n"))
    engine.sql("CREATE INDEX i ON t_isam(Edad) TYPE ISAM")
    assert rows(engine, "SELECT Id FROM t_isam WHERE Edad BETWEEN 30 AND 40") == [[2], [3], [4]]
    engine.load_csv("seq_kv", write("s.csv", "Clave,Valor\n1001,A\n1002,B\n1003,C\n1004,D\n"))
    engine.sql("CREATE INDEX i ON seq_kv(Clave) TYPE SEQ")
    for k in range(2000, 2015):
        engine.insert("seq_kv", [(k, f"X{k}")])
    assert rows(engine, "SELECT * FROM seq_kv WHERE Clave = 2010") == [[2010, "X"]]
    assert len(rows(engine, "SELECT * FROM seq_kv WHERE Clave BETWEEN 1003 AND 2002")) == 5
    assert engine.sql("DELETE FROM seq_kv WHERE Clave = 1003")[0].info["deleted"] == 1
    assert rows(engine, "SELECT Clave FROM seq_kv WHERE Clave BETWEEN 1001 AND 1004") == [[1001], [1002], [1004]]


def test_points_as_text_and_cities(engine, write):
    engine.sql("CREATE TABLE t_r (Id INT, Coord VARCHAR[32])")
    engine.sql("INSERT INTO t_r VALUES (1,'(10,10)'), (2,'(15, 15)'), (3,'[30,30]'), (4,'nowhere'), (5, '(1,2,3)')")
    q = "SELECT Id FROM t_r WHERE Coord IN ((12,12), 10)"
    assert rows(engine, q) == [[1], [2]]
    engine.sql("CREATE INDEX i ON t_r(Coord) TYPE RTREE")
    assert rows(engine, q) == [[1], [2]] and used(engine, q) == "RTREE"
    assert rows(engine, "SELECT Id FROM t_r WHERE Coord IN ((1,2,3), 0.5)") == [[5]]  # any dimension, by scan
    assert rows(engine, "SELECT Id FROM t_r WHERE Coord = 'nowhere'") == [[4]]  # equality is served by a scan
    engine.load_csv("cities", write("c.csv", "id,name,lat,lon\n1,A,36.68,71.53\n2,B,36.681,71.531\n3,C,40.0,10.0\n"))
    q = "SELECT id FROM cities WHERE lat, lon IN ((36.68, 71.53), {})"
    assert rows(engine, q.format(0.01)) == [[1], [2]]
    engine.sql("CREATE INDEX g ON cities(lat,lon) TYPE RTREE")
    assert rows(engine, q.format(0.01)) == [[1], [2]]
    assert rows(engine, q.format(0.0001)) == [[1]]
    engine.sql("INSERT INTO cities VALUES (4, 'D', 36.6801, 71.53)")
    assert rows(engine, q.format(0.0005)) == [[1], [4]]
    near = engine.knn("cities", ["lat", "lon"], (36.6811, 71.531), 2).rows()
    assert [r[0] for r in near] == [2, 4]


def test_exact_radius_and_knn(engine):
    engine.sql("CREATE TABLE p (id INT, x FLOAT, y FLOAT)")
    engine.sql("INSERT INTO p VALUES (100,2,2), (101,3,3), (102,8,8), (103,15,15), (104,2.5,2.5)")
    engine.sql("CREATE INDEX i ON p(x,y) TYPE RTREE")
    assert rows(engine, "SELECT id FROM p WHERE x, y IN ((0,0), 4)") == [[100], [104]]
    assert {r[0] for r in engine.knn("p", ["x", "y"], (2.2, 2.2), 3).rows()} == {100, 104, 101}


def test_limits_projection_and_order(engine):
    engine.sql("CREATE TABLE n (i INT)")
    engine.insert("n", [(i,) for i in range(150, 0, -1)])
    assert [r[0] for r in rows(engine, "SELECT * FROM n")] == list(range(150, 50, -1))
    assert len(rows(engine, "SELECT * FROM n LIMIT 0")) == 100
    assert rows(engine, "SELECT i, i FROM n LIMIT 2") == [[150, 150], [149, 149]]
    assert engine.select("n").frame.count() == 150
    with pytest.raises(CatalogError):
        engine.sql("SELECT nope FROM n")
    with pytest.raises(CatalogError):
        engine.sql("SELECT * FROM missing")
    with pytest.raises(CatalogError):
        engine.sql("CREATE TABLE n (i INT)")


def test_literals_fit_the_column(engine):
    engine.sql("CREATE TABLE t (i INT, f FLOAT, s VARCHAR[3], d DATE)")
    engine.sql("INSERT INTO t VALUES (1, 1.5, '007', '2024-01-31'), (2, 2, '', '2024-02-01')")
    assert rows(engine, "SELECT * FROM t WHERE s = '007'") == [[1, 1.5, "007", "2024-01-31"]]
    assert rows(engine, "SELECT i FROM t WHERE s = \"0079999\"") == [[1]]
    assert rows(engine, "SELECT i FROM t WHERE s = ''") == [[2]]
    assert rows(engine, "SELECT i FROM t WHERE i BETWEEN 1.5 AND 2.5") == [[2]]  # bounds are compared exactly
    assert rows(engine, "SELECT i FROM t WHERE d BETWEEN '2024-01-01' AND '2024-01-31'") == [[1]]
    with pytest.raises(SchemaError):
        engine.sql("SELECT * FROM t WHERE i = abc")
    with pytest.raises(SchemaError):
        engine.sql("INSERT INTO t VALUES (1, 2)")
    with pytest.raises(SchemaError):
        engine.sql("SELECT * FROM t WHERE i, s IN ((1,2), 3)")


def test_effects_before_a_failing_statement_last(engine):
    with pytest.raises(SchemaError):
        engine.sql("CREATE TABLE t (i INT); INSERT INTO t VALUES (1); INSERT INTO t VALUES ('x')")
    assert rows(engine, "SELECT * FROM t") == [[1]]
    with pytest.raises(ParseError):
        engine.sql("INSERT INTO t VALUES (2); UPDATE t SET i = 3")
    assert rows(engine, "SELECT * FROM t") == [[1]]


def test_index_lifecycle(engine):
    engine.sql("CREATE TABLE t (a INT INDEX BTREE, b VARCHAR[9])")
    engine.insert("t", [(i % 7, f"v{i % 5}") for i in range(50)])
    engine.sql("CREATE INDEX i ON t(a) TYPE HASH")  # replaces the other kind on the same column
    assert [i.kind for i in engine.catalog.load("t").indexes] == ["EHASH"]
    engine.sql("CREATE INDEX i ON t(b) TYPE SEQ")
    assert len(rows(engine, "SELECT * FROM t WHERE a = 3")) == 7
    engine.sql("DELETE FROM t WHERE b = 'v0'")
    assert len(rows(engine, "SELECT * FROM t WHERE a = 3")) == sum(1 for i in range(50) if i % 7 == 3 and i % 5)
    engine.sql("DROP INDEX ON t(a)")
    assert used(engine, "SELECT * FROM t WHERE a = 3") is None
    with pytest.raises(CatalogError):
        engine.sql("DROP INDEX ON t(a)")
    again = type(engine)(engine.spark, engine.catalog.warehouse)  # all state is in the warehouse
    assert again.catalog.tables() == ["t"] and used(again, "SELECT * FROM t WHERE b = 'v1'") == "SEQ"


def test_empty_table_and_nulls(engine):
    engine.sql("CREATE TABLE e (a INT INDEX BTREE, p VARCHAR[20] INDEX RTREE)")
    assert rows(engine, "SELECT * FROM e WHERE a = 1") == []
    assert engine.sql("DELETE FROM e WHERE a = 1")[0].info["deleted"] == 0
    engine.sql("INSERT INTO e VALUES (NULL, NULL), (1, '(1,1)')")
    assert rows(engine, "SELECT a FROM e WHERE p IN ((1,1), 1)") == [[1]]
    engine.sql("DELETE FROM e WHERE a = 1")
    assert rows(engine, "SELECT * FROM e") == [[None, None]]


def test_pruning_shows_in_the_plan(engine):
    engine.sql("CREATE TABLE t (a INT, b INT)")
    engine.insert("t", [(i, i) for i in range(400)])
    engine.sql("CREATE INDEX i ON t(a) TYPE HASH; CREATE INDEX j ON t(b) TYPE BTREE")
    plan = engine.select("t", ("b",), ast.Eq("a", "17")).frame._jdf.queryExecution().explainString(engine.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(__b" in plan
    plan = engine.select("t", ("a",), ast.Between("b", "5", "9")).frame._jdf.queryExecution().explainString(engine.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(b,5)" in plan


values = st.one_of(st.none(), st.integers(-5, 5))


@settings(max_examples=3, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(values, st.sampled_from(["", "a", "b", "ñ", "zz"]), st.floats(-2, 2)), min_size=1, max_size=12), st.lists(st.tuples(values, st.just("b"), st.just(-0.0)), max_size=3), st.integers(-5, 5))
def test_indexes_never_change_answers(spark, tmp_path_factory, first, later, v):
    from sparkdex.plans.engine import Engine

    e = Engine(spark, "file://" + str(tmp_path_factory.mktemp("w")))
    e.create_table("plain", [("i", "INT"), ("s", "VARCHAR[4]"), ("f", "FLOAT")])
    e.insert("plain", first)
    e.insert("plain", later) if later else None
    preds = [ast.Eq("i", v), ast.Eq("s", "b"), ast.Eq("f", 0), ast.Between("i", v - 2, v + 1), ast.Between("s", "a", "b"), ast.Radius(("i", "f"), (0.0, 0.0), 2.0)]
    answers = lambda t: [sorted(map(repr, e.select(t, where=p).rows())) for p in preds]
    want = answers("plain")
    for n, kind in enumerate(KINDS[v % 2 :: 2]):
        t = f"t{n}"
        e.create_table(t, [("i", "INT"), ("s", "VARCHAR[4]"), ("f", "FLOAT")], [("i", kind), ("s", kind), ("f", kind)])
        e.insert(t, first)
        for c in ("i", "s", "f"):
            e.create_index(t, [c], kind)
        e.create_index(t, ["i", "f"], "RTREE")
        e.insert(t, later) if later else None
        assert answers(t) == want, kind


def test_ranked_queries_need_their_index(engine):
    engine.sql("CREATE TABLE t (a VARCHAR[9])")
    with pytest.raises(EngineError):
        engine.sql("SELECT * FROM t WHERE a @@ 'x'")
    with pytest.raises(EngineError):
        engine.sql("SELECT * FROM t WHERE a <-> 'x.png'")


def test_deletes_are_marks_until_they_are_many(engine):
    engine.sql("CREATE TABLE t (a INT INDEX BTREE, b INT INDEX HASH)")
    engine.insert("t", [(i % 10, i) for i in range(100)])
    parts = engine.catalog.load("t").parts
    assert engine.sql("DELETE FROM t WHERE a = 3")[0].info == {"deleted": 10}
    e = engine.catalog.load("t")
    assert e.parts == parts and e.dead_rows == 10 and len(e.dead) == 1
    assert rows(engine, "SELECT * FROM t WHERE a = 3") == [] and rows(engine, "SELECT * FROM t WHERE b = 13") == []
    assert used(engine, "SELECT * FROM t WHERE b = 13") == "EHASH" and len(rows(engine, "SELECT * FROM t WHERE a BETWEEN 2 AND 4")) == 20
    assert engine.sql("DELETE FROM t WHERE a = 3")[0].info == {"deleted": 0}
    engine.insert("t", [(3, 1000)])
    assert rows(engine, "SELECT * FROM t WHERE a = 3") == [[3, 1000]]
    engine.sql("DELETE FROM t WHERE a = 4; DELETE FROM t WHERE a = 5")
    e = engine.catalog.load("t")
    assert e.dead == [] and len(e.parts) == 1 and e.sizes == [71]  # a fifth was gone: written anew
    assert len(rows(engine, "SELECT * FROM t WHERE a BETWEEN 3 AND 6")) == 11


def test_many_inserts_keep_few_parts(engine):
    engine.sql("CREATE TABLE t (a INT INDEX BTREE)")
    for i in range(20):
        engine.insert("t", [(i,)])
    e = engine.catalog.load("t")
    assert len(e.parts) < 10 and sum(e.sizes) == 20
    assert rows(engine, "SELECT a FROM t WHERE a BETWEEN 0 AND 30") == [[i] for i in range(20)]


def test_two_writers_do_not_undo_each_other(engine):
    engine.sql("CREATE TABLE t (a INT)")
    stale = engine.catalog.load("t")
    engine.insert("t", [(1,)])
    stale.parts.append("elsewhere")
    with pytest.raises(CatalogError):
        engine.catalog.save(stale)
    assert rows(engine, "SELECT * FROM t") == [[1]]


def test_ranked_index_takes_new_rows_as_a_segment(engine):
    engine.sql("CREATE TABLE d (id INT, txt VARCHAR[40])")
    engine.insert("d", [(i, f"comun palabra{chr(97 + i)}") for i in range(6)])
    engine.sql("CREATE FTS INDEX ON d(txt)")
    engine.insert("d", [(10, "nueva palabra"), (11, "comun nueva")])
    q = "SELECT id FROM d WHERE txt @@ 'nueva'"
    got = rows(engine, q)
    assert {r[1] for r in got} == {10, 11}
    spec = engine.catalog.load("d").indexes[0]
    assert [g["n_docs"] for g in spec.info["segments"]] == [6, 2] and spec.info["n_docs"] == 8
    engine.sql("CREATE FTS INDEX ON d(txt)")  # built at once
    assert rows(engine, q) == got
    engine.sql("DELETE FROM d WHERE id = 10")
    assert [r[1] for r in rows(engine, q)] == [11]
    assert engine.catalog.load("d").indexes[0].info["n_docs"] == 7


def test_knn_and_probes_through_indexes(engine, spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(5)
    data = [(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(400)] + [(400, 1e9, -1e9), (401, None, 1.0)]
    engine.sql("CREATE TABLE p (id INT, x FLOAT, y FLOAT)")
    engine.insert("p", data)
    plain = [engine.knn("p", ["x", "y"], q, k).rows() for q, k in (((50, 50), 7), ((1e9, 0), 2), ((-500, 3), 1), ((5, 5), 500))]
    engine.sql("CREATE INDEX g ON p(x, y) TYPE RTREE")
    engine.insert("p", [(500, 50.0, 50.0)])
    r = engine.knn("p", ["x", "y"], (50, 50), 8)
    assert r.used_index == {"column": "x,y", "type": "RTREE"} and [v[0] for v in r.rows()][0] == 500 and r.rows()[1:] == plain[0]
    assert [engine.knn("p", ["x", "y"], q, k).rows() for q, k in (((1e9, 0), 2), ((-500, 3), 1))] == plain[1:3]
    centers = spark.createDataFrame([(1, 10.0, 10.0), (2, 60.0, 40.0)], "center_id int, x double, y double")
    want = sorted((c, i) for c, cx, cy in ((1, 10, 10), (2, 60, 40)) for i, x, y in [*data, (500, 50.0, 50.0)] if x is not None and (x - cx) ** 2 + (y - cy) ** 2 <= 144)
    assert sorted(map(tuple, engine.radius_many("p", ["x", "y"], centers, 12.0).select("center_id", "id").collect())) == want
    keys = spark.createDataFrame([(3,), (77,), (None,), (999,), (3,)], "k int")
    ranges = spark.createDataFrame([(1, 5, 9), (2, 380, 390), (3, 9, 5)], "range_id int, low int, high int")
    for kind in ("HASH", "BTREE"):
        engine.create_index("p", ["id"], kind)
        assert sorted(r.id for r in engine.probe_many("p", "id", keys).collect()) == [3, 77]
        got = sorted(map(tuple, engine.ranges_many("p", "id", ranges).select("range_id", "id").collect()))
        assert got == [(1, i) for i in range(5, 10)] + [(2, i) for i in range(380, 391)]
