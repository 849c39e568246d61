"""Queries of statements, files, media and the service, each through the engine, with their SQL."""

from __future__ import annotations

import io
import json
import struct
import threading
import urllib.error
import urllib.parse
import urllib.request
import uuid
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdex.common import read_table, shared_dir
from sparkdex.functions.analyzer import Analyzer
from sparkdex.functions.types import RID
from sparkdex.operators import fulltext, media
from sparkdex.plans import ast
from sparkdex.plans.engine import Engine
from sparkdex.queries_reference import _SUPPLIER, _csv, api, attached, loaded, new_engine, run
from sparkdex.service import Service, serve
from sparkdex.sources import media as files
from sparkdex.streaming.feed import feed_table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- statements --------------------------------------------------------------------------


@query("select p_partkey::integer as p_partkey, p_brand, p_size from part where p_size = 17")
def sql_create_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table created from a CSV file with one index, read through it."""
    e = new_engine(spark)
    e.sql(f"CREATE TABLE parts FROM FILE \"{_csv(spark, sf_dir, 'part', ['p_partkey', 'p_brand', 'p_size'])}\" USING INDEX hash(p_size)")
    return api(e, "parts", ast.Eq("p_size", "17"))


@query("select n_nationkey::integer as n_nationkey, n_name from nation")
def csv_bytes_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of a CSV file loaded into a table of its own types."""
    rows = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # a fixed list of 25
    e = new_engine(spark)
    e.sql("CREATE TABLE n (n_nationkey INT INDEX BTREE, n_name VARCHAR[25])")
    e.load_csv_bytes("n", ("n_nationkey,n_name\n" + "".join(f'{r[0]},"{r[1]}"\n' for r in rows)).encode("utf-8"))
    return api(e, "n")


@query("select s_suppkey, s_name from supplier where s_suppkey % 7 = 0")
def fetch_by_rid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by record id, as a semi-join."""
    e = attached(spark, sf_dir, "supplier", "s_suppkey", ["s_suppkey", "s_name"])
    return e.fetch("supplier", read_table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select("s_suppkey")).drop(RID)


@query("select * from orders where o_custkey between 10 and 40 order by o_orderkey limit 12")
def limit_after_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that binds on the rows of an index, in insertion order."""
    e = attached(spark, sf_dir, "orders", "o_orderkey")
    e.sql("CREATE INDEX i ON orders(o_custkey) TYPE BTREE")
    return run(e, "SELECT * FROM orders WHERE o_custkey BETWEEN 10 AND 40 LIMIT 12")


@query("select * from (values (1, 'BTREE'), (2, 'EHASH'), (3, 'EHASH'), (4, 'none'), (5, 'none'), (6, 'RTREE'), (7, 'FTS')) t(step, used)")
def index_lifecycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access path reported as indexes are created, replaced and dropped."""
    e = new_engine(spark)
    e.sql("CREATE TABLE t (a INT INDEX BTREE, x FLOAT, y FLOAT, s VARCHAR[20]); INSERT INTO t VALUES (1, 2, 3, 'uno dos'), (2, 3, 4, 'tres')")
    steps = [
        ("", "SELECT * FROM t WHERE a BETWEEN 1 AND 2"), ("CREATE INDEX i ON t(a) TYPE HASH", "SELECT * FROM t WHERE a = 1"),
        ("INSERT INTO t VALUES (1, 5, 5, 'x')", "SELECT * FROM t WHERE a = 1"), ("", "SELECT * FROM t WHERE a BETWEEN 1 AND 2"),
        ("DROP INDEX ON t(a)", "SELECT * FROM t WHERE a = 1"), ("CREATE INDEX g ON t(x, y) TYPE RTREE", "SELECT * FROM t WHERE x, y IN ((2, 3), 1)"),
        ("CREATE FTS INDEX ON t(s)", "SELECT * FROM t WHERE s @@ 'tres'"),
    ]
    out = []
    for n, (change, ask) in enumerate(steps, 1):
        if change:
            e.sql(change)
        out.append((n, (e.sql(ask)[0].used_index or {}).get("type", "none")))
    return spark.createDataFrame(out, "step int, used string")


@query("select * from supplier where s_nationkey between 2 and 4 and s_nationkey <> 3 union all values (900001::bigint, 'otra vez', 3, 1.0::double)")
def delete_then_indexed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ordered index gives after a delete and an insert of the same key."""
    e = loaded(spark, sf_dir, "supplier", _SUPPLIER)
    e.sql("CREATE INDEX i ON supplier(s_nationkey) TYPE BTREE; DELETE FROM supplier WHERE s_nationkey = 3; INSERT INTO supplier VALUES (900001, 'otra vez', 3, 1)")
    return api(e, "supplier", ast.Between("s_nationkey", "2", "4"))


@query("select * from supplier where s_nationkey not in (1, 2, 3, 4, 5, 6, 7, 8)")
def delete_until_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes that outgrow their marks, so that table and index are written anew."""
    e = loaded(spark, sf_dir, "supplier", _SUPPLIER)
    e.sql("CREATE INDEX i ON supplier(s_nationkey) TYPE HASH;" + ";".join(f"DELETE FROM supplier WHERE s_nationkey = {k}" for k in range(1, 9)))
    return e.table("supplier")


@query("select region as k, count(*) as n from (select r_regionkey::integer as region from region union all select n_regionkey::integer from nation) group by 1")
def streams_into_one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams into one table, each batch once."""
    e = new_engine(spark)
    e.sql("CREATE TABLE t (k INT)")
    for name, column in (("region", "r_regionkey"), ("nation", "n_regionkey")):
        schema = read_table(spark, sf_dir, name).schema
        src = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
        feed_table(e, "t", src.select(F.col(column).cast("int").alias("k")), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").awaitTermination()
    return e.table("t").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


# --- indexes that serve many probes ---------------------------------------------------------


@query("select * from orders where o_custkey in (select c_custkey from customer where c_nationkey = 5)")
def batch_point_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = attached(spark, sf_dir, "orders", "o_orderkey")
    e.create_index("orders", ["o_custkey"], "HASH")
    return e.probe_many("orders", "o_custkey", read_table(spark, sf_dir, "customer").where("c_nationkey = 5").select("c_custkey"))


@query("""select p_partkey, (p_size - 25) * (p_size - 25) + (p_retailprice - 1000) * (p_retailprice - 1000) as d2 from part
    order by d2, p_partkey limit 10""")
def knn_points_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest points by the cells of an index."""
    e = attached(spark, sf_dir, "part", "p_partkey")
    e.create_index("part", ["p_size", "p_retailprice"], "RTREE")
    return e.knn("part", ["p_size", "p_retailprice"], (25.0, 1000.0), 10).frame.select("p_partkey", "d2")


@query("""with c as (select id, any_value(lat) as lat, any_value(lon) as lon from cities where lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) group by id),
    d as (select a.id as center_id, b.id, (b.lat - a.lat) * (b.lat - a.lat) + (b.lon - a.lon) * (b.lon - a.lon) as d2 from c a, c b where a.id % 100 = 0)
    select center_id, id, rank::integer as rank from (select *, row_number() over (partition by center_id order by d2, id) as rank from d) where rank <= 5""")
def batch_knn_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five cities nearest to each city whose id is divisible by 100."""
    from sparkdex.operators.batch import knn_many
    from sparkdex.queries_core import city_points

    points = city_points(spark, sf_dir)
    centers = points.where("id % 100 = 0").select(F.col("id").alias("center_id"), "x", "y")
    return knn_many(points, ["x", "y"], centers, 5, "id").select("center_id", "id", "rank")


# --- full text ------------------------------------------------------------------------------

#: Words and their stems as the published Spanish algorithm gives them.
_STEMS = (
    "cheque chequ chequeo cheque cheques chequ cheviot cheviot chica chic chico chic chicas chic chicos chic chihuahua chihuahu chocar choc torear tor toreo tore torero torer toros tor "
    "torneo torne torneos torne tortura tortur torturado tortur tornillo tornill"
).split()
_STEM_ROWS = ", ".join(f"('{w}', '{s}')" for w, s in zip(_STEMS[::2], _STEMS[1::2]))


@query(f"select w as word, s as term from (values {_STEM_ROWS}) t(w, s) where w not in ('la', 'de')")
def fts_spanish_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the Spanish analyzer; stop-words, words with digits and punctuation vanish."""
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(_STEMS[::2])], "doc_id bigint, word string")
    text = docs.select("doc_id", F.concat(F.lit("La, de ¡"), F.initcap("word"), F.lit("! x1 estuviéramos 22 también")).alias("text"))
    tf = fulltext.term_frequencies(text, Analyzer("spanish")).where("term not in ('estuvier', 'tambi')")
    return docs.join(tf, "doc_id").select("word", "term")


_SPANISH_DOCS = [(1, "Los toros y el torero"), (2, "Una chica en el torneo de chicos"), (3, "Torneos, torneos y más torneos"), (4, "el cheque de la chica"), (5, "")]


@query("""with tok as (select unnest([1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 4]) as id, unnest(['tor', 'torer', 'chic', 'torne', 'chic', 'torne', 'torne', 'mas', 'torne', 'chequ', 'chic']) as term),
    tf as (select id, term, 1 + log10(count(*)) as w from tok group by all), lex as (select term, log10(5 / count(*)::double) as idf from tf group by 1),
    norm as (select id, sqrt(sum(w * w)) as n from tf group by 1), q as (select term, idf from lex where term in ('torne', 'chic')),
    s as (select id, round(sum(q.idf * q.idf * w) / (any_value(norm.n) * (select sqrt(sum(idf * idf)) from q)), 6) as score from tf join q using (term) join norm using (id) group by id)
    select score, id::integer as id from s""")
def sql_create_fts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full-text index made by its statement, with the Spanish analyzer, asked with @@."""
    e = new_engine(spark)
    e.sql("CREATE TABLE d (id INT, txt VARCHAR[60])")
    e.insert("d", _SPANISH_DOCS[:2])
    e.sql("CREATE FTS INDEX ON d(txt)")
    e.insert("d", _SPANISH_DOCS[2:])
    return run(e, "SELECT id FROM d WHERE txt @@ 'los torneos de las chicas'")


# --- media ----------------------------------------------------------------------------------


def _png(img: np.ndarray) -> bytes:
    h, w = img.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\x00" + row.tobytes() for row in img.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _picture(n: int) -> bytes:
    """Stripes whose direction and width tell the number; 48 wide, 32 high."""
    y, x = np.mgrid[:32, :48]
    a = n * 0.12
    return _png(127 + 120 * np.sin((x * np.cos(a) + y * np.sin(a)) / (1.5 + n % 5)))


def _sound(n: int) -> bytes:
    """Two tones that tell the number, (n + 4) / 10 seconds at 22,050 Hz."""
    t = np.arange(2205 * (n + 4)) / 22050
    x = np.where(t < t[-1] * (n % 5 + 1) / 7, np.sin(2 * np.pi * (200 + 150 * n) * t), np.sin(2 * np.pi * (5000 - 90 * n) * t))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(22050)
        w.writeframes((x * 20000).astype("<i2").tobytes())
    return out.getvalue()


def _media(spark: SparkSession, sf_dir: str, kind: str) -> tuple[Engine, str]:
    """A table (id, name, path) with one file per nation, and the folder of the files."""
    e = new_engine(spark)
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex[:12]}"
    rows = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # a fixed list of 25
    ext, make = ("png", _picture) if kind == "image" else ("wav", _sound)
    for r in rows:
        e.catalog.files.write_bytes(f"{folder}/{r[0]}.{ext}", make(r[0]))
    e.sql("CREATE TABLE m (id INT, name VARCHAR[25], path VARCHAR[255])")
    e.insert("m", [(r[0], r[1], f"{folder}/{r[0]}.{ext}") for r in rows])
    return e, folder


def _top_sql(key: int) -> str:
    return f"select 1.0::double as score, n_nationkey::integer as id, n_name as name from nation where n_nationkey = {key}"


@query(_top_sql(24))
def mm_image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures indexed by their statement; the most similar of one is itself."""
    e, folder = _media(spark, sf_dir, "image")
    e.sql("CREATE MM INDEX ON m(path) TYPE BOVW K=24")
    return run(e, f"SELECT id, name FROM m WHERE path <-> '{folder}/24.png' USING K=24 LIMIT 1")


@query(_top_sql(24))
def mm_audio_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds indexed by their statement, asked without a K: that of the index."""
    e, folder = _media(spark, sf_dir, "audio")
    e.sql("CREATE MM INDEX ON m(path) TYPE BOAW K=20")
    return run(e, f"SELECT id, name FROM m WHERE path <-> '{folder}/24.wav' LIMIT 1")


@query("select count(*) as objects, 25 as best from nation")
def mm_sequential_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MODE='SEQ' ranks every object; how many, and the place of the object asked for counted from the end."""
    e, folder = _media(spark, sf_dir, "audio")
    e.sql("CREATE MM INDEX ON m(path) TYPE BOAW K=20")
    r = run(e, f"SELECT id FROM m WHERE path <-> '{folder}/24.wav' MODE='SEQ'")
    return r.agg(F.count(F.lit(1)).alias("objects"), (F.max(F.when(F.col("score") == 1.0, F.col("id"))) + 1).cast("int").alias("best"))


@query(_top_sql(24) + " union all " + _top_sql(23))
def mm_query_bytes_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of a file as the question, before its object is deleted, and the one before it after."""
    e, folder = _media(spark, sf_dir, "image")
    e.sql("CREATE MM INDEX ON m(path) TYPE BOVW K=24")
    pick = ["score", "id", "name"]
    first = spark.createDataFrame(e.similar_to_bytes("m", "path", "x.png", _picture(24), limit=1).frame.select(*pick).collect(), "score double, id int, name string")
    e.sql("DELETE FROM m WHERE id = 24")
    return first.unionByName(e.similar_to_bytes("m", "path", "x.png", _picture(23), limit=1).frame.select(*pick))


@query("select * from (values (1, 'MM', 'INDEX'), (2, 'none', 'SEQ')) t(step, used, method)")
def mm_access_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, folder = _media(spark, sf_dir, "image")
    e.sql("CREATE MM INDEX ON m(path) TYPE BOVW K=8")
    out = []
    for i, mode in enumerate(("INDEX", "SEQ"), 1):
        r = e.sql(f"SELECT id FROM m WHERE path <-> '{folder}/3.png' MODE='{mode}' LIMIT 1")[0]
        out.append((i, (r.used_index or {}).get("type", "none"), r.used_method))
    return spark.createDataFrame(out, "step int, used string, method string")


@query("select n_nationkey::integer as id, 15::bigint as descriptors, 128 as dim from nation")
def image_descriptor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient descriptors of each picture: patches of 16 in steps of 8, read and computed by the tasks."""
    e, _ = _media(spark, sf_dir, "image")
    d = files.extract(e.table("m").select(F.col("id").alias("obj_id"), "path"), "image")
    return d.groupBy(F.col("obj_id").cast("int").alias("id")).agg(F.count("descriptor").alias("descriptors"), F.max(F.size("descriptor")).alias("dim"))


@query("select n_nationkey::integer as id, (1 + 2205 * (n_nationkey + 4) // 512)::bigint as descriptors, 13 as dim from nation")
def sound_descriptor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cepstral frames of each sound, one every 512 samples."""
    e, _ = _media(spark, sf_dir, "audio")
    d = files.extract(e.table("m").select(F.col("id").alias("obj_id"), "path"), "audio")
    return d.groupBy(F.col("obj_id").cast("int").alias("id")).agg(F.count("descriptor").alias("descriptors"), F.max(F.size("descriptor")).alias("dim"))


@query("select n_nationkey || '.png' as name, 32 as height, 48 as width, 1 as channels from nation")
def image_file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a folder decoded on the JVM."""
    _, folder = _media(spark, sf_dir, "image")
    return files.image_source(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "height", "width", "channels")


@query("select * from (values ('a/b.WAV', 'audio'), ('c.png', 'image'), ('d', 'image'), ('e.flac', 'audio'), ('column', 'image'), ('sounds', 'audio')) t(name, modality)")
def media_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modality of a query file by its extension, and of columns by theirs."""
    frame = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    rows = [(n, files.modality_of(n)) for n in ("a/b.WAV", "c.png", "d", "e.flac")]
    rows += [("column", files.collection_modality(frame("a.wav", "b.png"))), ("sounds", files.collection_modality(frame("a.wav", None, "x.txt")))]
    return spark.createDataFrame(rows, "name string, modality string")


@query("select count(*) as size from embeddings group by vec_id % 4")
def bow_codebook_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words trained on four far-apart heaps: each heap is one word."""
    e = read_table(spark, sf_dir, "embeddings")
    d = e.select(F.col("vec_id").alias("obj_id"), F.transform("embedding", lambda v: v + F.col("vec_id") % 4 * 1000.0).cast("array<float>").alias("descriptor"))
    book = media.train_codebook(d, 4)
    return media.quantize(d, book).groupBy("word").agg(F.count(F.lit(1)).alias("size")).select("size")


# --- service --------------------------------------------------------------------------------


class _Http:
    """A service on a free port of this machine, for the time of a query."""

    def __init__(self, engine: Engine):
        self.server = serve(Service(engine), 0)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"

    def __enter__(self) -> _Http:
        return self

    def __exit__(self, *_) -> None:
        self.server.shutdown()
        self.server.server_close()

    def get(self, path: str, data: bytes | None = None, **params: str) -> object:
        url = self.base + path + ("?" + urllib.parse.urlencode(params) if params else "")
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data)) as r:
                body = r.read()
                return json.loads(body) if "json" in r.headers.get("Content-Type", "") else body.decode()
        except urllib.error.HTTPError as e:
            return {"status": e.code}


@query("select n_nationkey::integer as k, n_name as name from nation where n_regionkey = 2")
def service_upload_and_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV upload, a script of statements and its rows, over HTTP."""
    rows = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # a fixed list of 25
    with _Http(new_engine(spark)) as http:
        http.get("/api/upload", ("k,name,r\n" + "".join(f"{r[0]},{r[1]},{r[2]}\n" for r in rows)).encode(), table="n", name="n.csv", has_header="true")
        out = http.get("/api/sql", json.dumps({"query": "CREATE INDEX i ON n(r) TYPE HASH; SELECT k, name FROM n WHERE r = 2"}).encode())
    return spark.createDataFrame([tuple(r) for r in out["results"][1]["rows"]], "k int, name string")


@query("""select * from (values ('tables', 't,u'), ('schema', 'a INT, b VARCHAR'), ('indexes', 'a BTREE'), ('page', 'true'), ('bad statement', '400'), ('similarity without file', '400'), ('not a csv', '400'))
    t(what, got)""")
def service_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing, the schema, the page, and the codes of refused requests."""
    e = new_engine(spark)
    e.sql("CREATE TABLE t (a INT INDEX BTREE, b VARCHAR[9]); CREATE TABLE u (c FLOAT)")
    sql = lambda q: json.dumps({"query": q}).encode()
    with _Http(e) as http:
        schema = http.get("/api/tables/t/schema")
        rows = [
            ("tables", ",".join(http.get("/api/tables"))), ("schema", ", ".join(f"{c[0]} {c[1]}" for c in schema["schema"])), ("indexes", ", ".join(" ".join(i) for i in schema["indexes"])),
            ("page", str("<textarea" in http.get("/")).lower()), ("bad statement", str(http.get("/api/sql", sql("SELECT"))["status"])),
            ("similarity without file", str(http.get("/api/sql", sql("SELECT * FROM t WHERE b <-> 'x.png'"))["status"])), ("not a csv", str(http.get("/api/upload", b"x", table="z", name="z.txt")["status"])),
        ]
    return spark.createDataFrame(rows, "what string, got string")


@query("select 24 as id, '1.000000' as score")
def service_media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A similarity query with its file, over HTTP."""
    e, _ = _media(spark, sf_dir, "image")
    e.sql("CREATE MM INDEX ON m(path) TYPE BOVW K=24")
    with _Http(e) as http:
        out = http.get("/api/sql_mm_query", _picture(24), query="SELECT id FROM m WHERE path <-> 'up.png' USING K=24 LIMIT 1", name="up.png")
    r = out["results"][0]
    (row,) = [dict(zip(r["columns"], v)) for v in r["rows"]]
    return spark.createDataFrame([(row["id"], row["score"])], "id int, score string")
