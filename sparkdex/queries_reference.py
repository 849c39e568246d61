"""Queries of the engine's own operators, each through the engine, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdex.common import read_table, shared_dir
from sparkdex.functions.analyzer import Analyzer
from sparkdex.functions.types import RID
from sparkdex.operators import fulltext, media
from sparkdex.operators.layouts import SortedBase
from sparkdex.plans import ast
from sparkdex.plans.engine import Engine

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def new_engine(spark: SparkSession) -> Engine:
    """An engine with a warehouse of its own in the shared folder."""
    return Engine(spark, f"{shared_dir(spark)}/warehouse-{uuid.uuid4().hex[:12]}")


def attached(spark: SparkSession, sf_dir: str, table: str, rid: str, columns: list[str] | None = None) -> Engine:
    e = new_engine(spark)
    e.attach(table, f"{sf_dir.rstrip('/')}/{table}.parquet", rid, columns)
    return e


def loaded(spark: SparkSession, sf_dir: str, table: str, columns: list[tuple[str, str]], order: str | None = None) -> Engine:
    """A table of the engine's own with rows of a parquet table."""
    e = new_engine(spark)
    e.create_table(table, columns)
    e.insert_frame(table, read_table(spark, sf_dir, table).select(*[c for c, _ in columns]))
    return e


def run(e: Engine, sql: str) -> DataFrame:
    return e.sql(sql)[-1].frame


def api(e: Engine, table: str, where: ast.Predicate | None = None, columns: tuple[str, ...] = ("*",), limit: int | None = None) -> DataFrame:
    return e.select(table, columns, where, limit).frame


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts_topk(spark, sf_dir)


# --- projection, filters, limit --------------------------------------------------------


@query("select * from orders order by o_orderkey limit 100")
def select_star_limit(spark, sf_dir):
    return run(attached(spark, sf_dir, "orders", "o_orderkey"), "SELECT * FROM orders")


@query("select c_name, c_acctbal from customer")
def project_columns(spark, sf_dir):
    return api(attached(spark, sf_dir, "customer", "c_custkey"), "customer", columns=("c_name", "c_acctbal"))


@query("select * from orders where o_custkey = 370")
def eq_int(spark, sf_dir):
    return api(attached(spark, sf_dir, "orders", "o_orderkey"), "orders", ast.Eq("o_custkey", "370"))


@query("select l_orderkey, l_linenumber, l_discount from lineitem where l_discount = 0.05")
def eq_float(spark, sf_dir):
    return api(attached(spark, sf_dir, "lineitem", "l_orderkey"), "lineitem", ast.Eq("l_discount", "0.05"), ("l_orderkey", "l_linenumber", "l_discount"))


@query("select * from customer where c_mktsegment = 'BUILDING'")
def eq_varchar(spark, sf_dir):
    return api(attached(spark, sf_dir, "customer", "c_custkey"), "customer", ast.Eq("c_mktsegment", "BUILDING"))


@query("select p_partkey, left(p_name, 5) as p_name from part where left(p_name, 5) = left((select min(p_name) from part), 5)")
def eq_varchar_truncated(spark, sf_dir):
    e = new_engine(spark)
    e.create_table("part", [("p_partkey", "INT"), ("p_name", "VARCHAR[5]")])
    p = read_table(spark, sf_dir, "part")
    from sparkdex.functions.types import truncate_bytes

    e.insert_frame("part", p.select("p_partkey", truncate_bytes(F.col("p_name"), 5).alias("p_name")))
    first = p.agg(F.min("p_name")).first()[0]
    return api(e, "part", ast.Eq("p_name", first)).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("select * from orders where o_orderkey between 200 and 900")
def between_int(spark, sf_dir):
    return api(attached(spark, sf_dir, "orders", "o_orderkey"), "orders", ast.Between("o_orderkey", "200", "900"))


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice between 1000.5 and 2000.25")
def between_float(spark, sf_dir):
    return api(attached(spark, sf_dir, "lineitem", "l_orderkey"), "lineitem", ast.Between("l_extendedprice", "1000.5", "2000.25"), ("l_orderkey", "l_linenumber", "l_extendedprice"))


@query("select p_partkey, p_brand from part where p_brand between 'Brand#2' and 'Brand#4'")
def between_varchar(spark, sf_dir):
    return api(attached(spark, sf_dir, "part", "p_partkey"), "part", ast.Between("p_brand", "Brand#2", "Brand#4"), ("p_partkey", "p_brand"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where strftime(o_orderdate, '%Y-%m-%d') between '1995-01-01' and '1995-06-30'")
def between_date_text(spark, sf_dir):
    e = new_engine(spark)
    e.create_table("days", [("o_orderkey", "INT"), ("day", "DATE")])
    e.insert_frame("days", read_table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))
    return api(e, "days", ast.Between("day", "1995-01-01", "1995-06-30")).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


# --- index kinds -----------------------------------------------------------------------


def _indexed(spark, sf_dir, column, kind) -> Engine:
    e = attached(spark, sf_dir, "orders", "o_orderkey")
    e.create_index("orders", [column], kind)
    return e


def _index_query(name: str, kind: str, column: str, where: ast.Predicate, sql: str) -> None:
    def f(spark, sf_dir):
        return api(_indexed(spark, sf_dir, column, kind), "orders", where)

    f.__name__ = name
    query(sql)(f)


for _kind, _label in (("HASH", "hash"), ("BTREE", "btree"), ("ISAM", "isam"), ("SEQ", "seq")):
    _index_query(f"index_{_label}_eq", _kind, "o_custkey", ast.Eq("o_custkey", "370"), "select * from orders where o_custkey = 370")
    if _kind != "HASH":
        _index_query(
            f"index_{_label}_range", _kind, "o_totalprice", ast.Between("o_totalprice", "100000", "120000"), "select * from orders where o_totalprice between 100000 and 120000"
        )
_index_query("hash_between_fallback", "HASH", "o_custkey", ast.Between("o_custkey", "10", "20"), "select * from orders where o_custkey between 10 and 20")


# --- inserts and deletes -----------------------------------------------------------------

_SUPPLIER = [("s_suppkey", "LONG"), ("s_name", "VARCHAR[25]"), ("s_nationkey", "INT"), ("s_acctbal", "FLOAT")]


@query("select * from supplier where s_nationkey is distinct from 3")
def delete_eq_remaining(spark, sf_dir):
    e = loaded(spark, sf_dir, "supplier", _SUPPLIER)
    e.create_index("supplier", ["s_nationkey"], "BTREE")
    e.sql("DELETE FROM supplier WHERE s_nationkey = 3")
    return e.table("supplier")


@query("select count(*) as deleted from supplier where s_nationkey = 3")
def delete_eq_count(spark, sf_dir):
    e = loaded(spark, sf_dir, "supplier", _SUPPLIER)
    n = e.sql("DELETE FROM supplier WHERE s_nationkey = 3")[0].info["deleted"]
    return spark.createDataFrame([(n,)], "deleted bigint")


@query("select * from supplier where s_nationkey = 7 union all values (900001::bigint, 'nuevo uno', 7, 10.5::double), (900002, 'nuevo dos', 7, 20.0)")
def insert_then_select(spark, sf_dir):
    e = loaded(spark, sf_dir, "supplier", _SUPPLIER)
    e.sql("CREATE INDEX i ON supplier(s_nationkey) TYPE HASH")
    e.sql("INSERT INTO supplier VALUES (900001, 'nuevo uno', 7, 10.5); INSERT INTO supplier VALUES (900002, 'nuevo dos', 7, 20)")
    return api(e, "supplier", ast.Eq("s_nationkey", "7"))


@query("select o_orderkey, o_custkey from orders where o_custkey between 100 and 140 and o_custkey <> 120 union all values (9000001::bigint, 110::bigint), (9000002, 139)")
def isam_delta_range(spark, sf_dir):
    base = SortedBase(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias(RID)), "o_custkey")
    base.insert(spark.createDataFrame([(9000001, 110, 9000001), (9000002, 139, 9000002)], f"o_orderkey bigint, o_custkey bigint, {RID} bigint"))
    base.remove(120)
    return base.range_search(100, 140).drop(RID)


# --- files -----------------------------------------------------------------------------


def _csv(spark, sf_dir, table, columns) -> str:
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    read_table(spark, sf_dir, table).select(*columns).coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@query("select p_partkey::integer as p_partkey, p_name, p_size, p_retailprice from part")
def csv_roundtrip(spark, sf_dir):
    e = new_engine(spark)
    e.load_csv("parts", _csv(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size", "p_retailprice"]))
    return e.table("parts")


@query("""select 0 as position, 'p_partkey' as column_name, 'INT' as type, null::integer as length
    union all select 1, 'p_brand', 'VARCHAR', max(strlen(p_brand))::integer from part
    union all select 2, 'p_retailprice', 'FLOAT', null""")
def csv_inferred_schema(spark, sf_dir):
    e = new_engine(spark)
    e.load_csv("parts", _csv(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_retailprice"]))
    return e.catalog.schema_frame("parts").drop("indexes")


# --- spatial ---------------------------------------------------------------------------


@query("select p_partkey, p_size, p_retailprice from part where (p_size - 25) * (p_size - 25) + (p_retailprice - 1000) * (p_retailprice - 1000) <= 100")
def radius_two_columns(spark, sf_dir):
    e = attached(spark, sf_dir, "part", "p_partkey")
    e.create_index("part", ["p_size", "p_retailprice"], "RTREE")
    return api(e, "part", ast.Radius(("p_size", "p_retailprice"), (25.0, 1000.0), 10.0), ("p_partkey", "p_size", "p_retailprice"))


@query("""with t as (select id, hoja, trim(coord) as c from rt_coord),
    p as (select id, hoja, string_split(regexp_replace(c, '[()\\[\\]\\s]', '', 'g'), ',') as v from t
          where regexp_full_match(c, '(\\(\\s*[+-]?[0-9]+(\\.[0-9]+)?\\s*,\\s*[+-]?[0-9]+(\\.[0-9]+)?\\s*\\)|\\[\\s*[+-]?[0-9]+(\\.[0-9]+)?\\s*,\\s*[+-]?[0-9]+(\\.[0-9]+)?\\s*\\]|[+-]?[0-9]+(\\.[0-9]+)?\\s*,\\s*[+-]?[0-9]+(\\.[0-9]+)?)'))
    select id, hoja from p where (v[1]::double - 100000) * (v[1]::double - 100000) + (v[2]::double - 100000) * (v[2]::double - 100000) <= 6400000000""")
def radius_point_text(spark, sf_dir):
    e = attached(spark, sf_dir, "rt_coord", "id", ["id", "coord", "hoja"])
    e.create_index("rt_coord", ["coord"], "RTREE")
    return api(e, "rt_coord", ast.Radius(("coord",), (100000.0, 100000.0), 80000.0), ("id", "hoja"))


@query("""select p_partkey, (p_size - 25) * (p_size - 25) + (p_retailprice - 1000) * (p_retailprice - 1000) as d2 from part
    order by d2, p_partkey limit 10""")
def knn_points(spark, sf_dir):
    return attached(spark, sf_dir, "part", "p_partkey").knn("part", ["p_size", "p_retailprice"], (25.0, 1000.0), 10).frame.select("p_partkey", "d2")


@query("select * from orders where o_custkey in (select c_custkey from customer where c_custkey % 5 = 0)")
def batch_point_lookup(spark, sf_dir):
    keys = read_table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select("c_custkey")
    return attached(spark, sf_dir, "orders", "o_orderkey").probe_many("orders", "o_custkey", keys)


@query("select c_custkey as range_id, o_orderkey from customer join orders on o_orderkey between c_custkey * 10 and c_custkey * 10 + 19 where c_custkey % 3 = 0")
def batch_range_lookup(spark, sf_dir):
    r = read_table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("range_id"), (F.col("c_custkey") * 10).alias("low"), (F.col("c_custkey") * 10 + 19).alias("high"))
    return attached(spark, sf_dir, "orders", "o_orderkey").ranges_many("orders", "o_orderkey", r).select("range_id", "o_orderkey")


@query("""with c as (select distinct id, lat, lon from cities where lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0))
    select a.id as center_id, b.id from c a join c b on b.lat between a.lat - 0.0025 and a.lat + 0.0025
    where a.id % 20 = 0 and (a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon) <= 0.00200005 * 0.00200005""")
def batch_radius_search(spark, sf_dir):
    from sparkdex.operators.batch import radius_many
    from sparkdex.queries_core import city_points

    points = city_points(spark, sf_dir)
    centers = points.where("id % 20 = 0").select(F.col("id").alias("center_id"), "x", "y")
    return radius_many(points, ["x", "y"], centers, 0.00200005).select("center_id", "id")


# --- full text ---------------------------------------------------------------------------

_FTS = r"""tok as (select rid as doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(title, '') || ' ' || coalesce(body, ''))), '\p{L}+')) as term from fts_corpus),
    tf as (select doc_id, term, count(*) as tf from tok group by all),
    lex as (select term, count(*) as df, log10((select count(*) from fts_corpus) / count(*)::double) as idf from tf group by term),
    norm as (select doc_id, count(*) as n_terms, sqrt(sum(power(1 + log10(tf), 2))) as norm from tf group by doc_id)"""


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "fts_corpus").select(F.col("rid").alias("doc_id"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("text"))


def _simple_tf(spark, sf_dir):
    return fulltext.term_frequencies(_docs(spark, sf_dir), Analyzer("simple"))


@query(f"with {_FTS} select doc_id, term, tf from tf")
def fts_term_freq(spark, sf_dir):
    return _simple_tf(spark, sf_dir).select("doc_id", "term", "tf")


@query(f"with {_FTS} select term, df, round(idf, 6) as idf from lex")
def fts_doc_freq_idf(spark, sf_dir):
    lex = fulltext.document_frequencies(_simple_tf(spark, sf_dir), _docs(spark, sf_dir).count())
    return lex.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_FTS} select rid as doc_id, coalesce(n_terms, 0) as n_terms, round(coalesce(norm, 0), 6) as norm from fts_corpus left join norm on rid = doc_id")
def fts_doc_norms(spark, sf_dir):
    return fulltext.doc_norms(_docs(spark, sf_dir), Analyzer("simple")).select("doc_id", "n_terms", F.round("norm", 6).alias("norm"))


@query(f"with {_FTS} select term, doc_id, tf, round((1 + log10(tf)) * idf, 6) as weight from tf join lex using (term)")
def fts_postings(spark, sf_dir):
    tf = _simple_tf(spark, sf_dir)
    w = fulltext.posting_weights(tf, fulltext.document_frequencies(tf, _docs(spark, sf_dir).count()))
    return w.select("term", "doc_id", "tf", F.round("weight", 6).alias("weight"))


def _fts_sql(terms: list[str], k: int) -> str:
    words = ", ".join(f"'{t}'" for t in terms)
    return f"""with {_FTS},
        q as (select term, idf from lex where term in ({words})), qn as (select sqrt(sum(idf * idf)) as qn from q),
        s as (select doc_id, round(sum(q.idf * q.idf * (1 + log10(tf))) / (any_value(qn) * any_value(norm)), 6) as score
              from tf join q using (term) join norm using (doc_id), qn where qn > 0 group by doc_id)
        select score, rid, title from s join fts_corpus on rid = doc_id order by score desc, rid desc limit {k}"""


def _fts(spark, sf_dir, text, k, profile="simple"):
    e = attached(spark, sf_dir, "fts_corpus", "rid", ["rid", "title", "body"])
    e.create_fts("fts_corpus", ["title", "body"], profile)
    return run(e, f"SELECT rid, title FROM fts_corpus WHERE body @@ '{text}' LIMIT {k}")


@query(_fts_sql(["recorrido", "nocturno", "orquesta"], 20))
def fts_topk(spark, sf_dir):
    return _fts(spark, sf_dir, "recorrido nocturno orquesta", 20)


@query(_fts_sql(["biblioteca", "lectura", "publica"], 50))
def fts_multi_column(spark, sf_dir):
    return _fts(spark, sf_dir, "Biblioteca, lectura PÚBLICA", 50)


@query("select 0.0::double as score, rid, title from fts_corpus where false")
def fts_no_match(spark, sf_dir):
    return _fts(spark, sf_dir, "xyzzyplugh", 10)


@query("""with t as (select unnest([1, 2, 3]) as id, unnest(['comun rara', 'comun', 'comun comun']) as txt)
    select case id when 1 then round(log10(3.0) * log10(3.0) / (log10(3.0) * sqrt(2.0)), 6) else 0.0 end as score, id, txt from t""")
def fts_zero_idf(spark, sf_dir):
    e = new_engine(spark)
    e.sql("CREATE TABLE d (id INT, txt VARCHAR[40]); INSERT INTO d VALUES (1, 'comun rara'), (2, 'comun'), (3, 'comun comun')")
    e.create_fts("d", ["txt"], "simple")
    return run(e, "SELECT id, txt FROM d WHERE txt @@ 'comun rara'")


@query()
def fts_spanish_topk(spark, sf_dir):
    return _fts(spark, sf_dir, "las recetas de la sierra", 20, "spanish")


# --- media -------------------------------------------------------------------------------

_BOW = """e as (select * from embeddings), cb as (select vec_id as w, embedding as ctr from e where vec_id < 8),
    nn as (select vec_id, arg_min(w, (d, w)) as w from (select e.vec_id, cb.w,
        list_sum(list_transform(list_zip(e.embedding, cb.ctr), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as d from e, cb) group by 1),
    tf as (select (vec_id // 10)::bigint as obj_id, w::integer as word, count(*) as tf from nn group by all),
    n as (select count(distinct obj_id) as n from tf),
    x as (select obj_id, word, tf, ln((n.n + 1) / (df + 1)::double) + 1 as idf, tf * (ln((n.n + 1) / (df + 1)::double) + 1) as x
          from tf join (select word, count(*) as df from tf group by 1) using (word), n),
    nr as (select obj_id, sqrt(sum(x * x)) as nrm from x group by 1)"""


def _bow(spark, sf_dir):
    import numpy as np

    e = read_table(spark, sf_dir, "embeddings")
    book = np.array([r["embedding"] for r in e.where("vec_id < 8").orderBy("vec_id").collect()], dtype=np.float64)  # the eight centres of the test codebook
    d = e.select(F.expr("vec_id div 10").alias("obj_id"), F.col("embedding").alias("descriptor"), "vec_id")
    return d, book


def _bow_weights(spark, sf_dir):
    d, book = _bow(spark, sf_dir)
    h = media.histograms(media.quantize(d, book))
    return media.word_weights(h, h.select("obj_id").distinct().count())


@query(f"with {_BOW} select obj_id, word, tf from tf")
def bow_histogram(spark, sf_dir):
    d, book = _bow(spark, sf_dir)
    return media.histograms(media.quantize(d, book))


@query(f"with {_BOW} select vec_id as obj_id, w::integer as word from nn")
def bow_quantize(spark, sf_dir):
    d, book = _bow(spark, sf_dir)
    return media.quantize(d.drop("obj_id").withColumnRenamed("vec_id", "obj_id"), book)


@query(f"with {_BOW} select obj_id, word, tf, round(idf, 6) as idf, round(x, 6) as weight from x")
def bow_idf_weights(spark, sf_dir):
    return _bow_weights(spark, sf_dir).select("obj_id", "word", "tf", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


def _bow_search(spark, sf_dir, mode):
    w = _bow_weights(spark, sf_dir)
    q = {r["word"]: r["weight"] for r in w.where("obj_id = 0").collect()}  # at most eight words
    return media.similar(w, q, 5, mode, w.select("obj_id").distinct())


@query(f"""with {_BOW} select x.obj_id, round(sum(x.x * q.x) / (any_value(nr.nrm) * (select nrm from nr where obj_id = 0)), 6) as score
    from x join x q on q.word = x.word and q.obj_id = 0 join nr on nr.obj_id = x.obj_id group by 1 order by 2 desc, 1 desc limit 5""")
def bow_knn_index(spark, sf_dir):
    return _bow_search(spark, sf_dir, "INDEX")


@query(f"""with {_BOW}, dot as (select x.obj_id, sum(x.x * q.x) as d from x join x q on q.word = x.word and q.obj_id = 0 group by 1)
    select nr.obj_id, round(coalesce(d, 0) / (nr.nrm * (select nrm from nr where obj_id = 0)), 6) as score
    from nr left join dot using (obj_id) order by 2 desc, 1 desc limit 5""")
def bow_knn_seq(spark, sf_dir):
    return _bow_search(spark, sf_dir, "SEQ")


@query()
def bow_kmeans_sizes(spark, sf_dir):
    d, _ = _bow(spark, sf_dir)
    book = media.train_codebook(d, 16)
    return media.quantize(d, book).groupBy("word").agg(F.count(F.lit(1)).alias("size"))


# --- catalog and scripts ---------------------------------------------------------------------


@query("values ('region'), ('t1')")
def catalog_tables(spark, sf_dir):
    e = attached(spark, sf_dir, "region", "r_regionkey")
    e.sql("CREATE TABLE t1 (a INT, b VARCHAR[9] INDEX HASH, c FLOAT INDEX BTREE)")
    return e.catalog.tables_frame()


SQL["catalog_tables"] = "select * from (values ('region'), ('t1')) t(table_name)"


@query("""select * from (values (0, 'a', 'INT', null::integer, ''), (1, 'b', 'VARCHAR', 9, 'EHASH'), (2, 'c', 'FLOAT', null, 'BTREE,RTREE'), (3, 'd', 'FLOAT', null, 'RTREE'))
    t(position, column_name, type, length, indexes)""")
def catalog_schema(spark, sf_dir):
    e = new_engine(spark)
    e.sql("CREATE TABLE t1 (a INT, b VARCHAR[9] INDEX HASH, c FLOAT INDEX BTREE, d FLOAT); CREATE INDEX g ON t1(c, d) TYPE RTREE")
    return e.catalog.schema_frame("t1")


@query("select * from (values (1, 'ana', 30.5::double), (3, 'o''neil; x', 41.0)) t(id, name, age)")
def script_multi_statement(spark, sf_dir):
    e = new_engine(spark)
    return run(
        e,
        """CREATE TABLE people (id INT INDEX BTREE, name VARCHAR[20], age FLOAT);
        INSERT INTO people VALUES (1, 'ana', 30.5); INSERT INTO people VALUES (2, "luis", 25), (3, 'o''neil; x', 41);
        DELETE FROM people WHERE name = luis; SELECT * FROM people WHERE age BETWEEN 26 AND 50;""",
    )
