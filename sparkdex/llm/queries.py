"""Queries of the training-data problems, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdex.common import read_table
from sparkdex.llm.clusters import describe_clusters, pivot_clusters, usable_vector
from sparkdex.llm.distinctive import distinctive_terms
from sparkdex.llm.leakage import find_leaks
from sparkdex.llm.ngrams import count_ngrams, mark_terms, text_suffixes
from sparkdex.llm.packing import pack_texts
from sparkdex.llm.pii import find_personal, redact_personal
from sparkdex.llm.similar import similar_objects
from sparkdex.llm.terms import record_counts, term_records, text_content
from sparkdex.llm.truncation import find_truncated, truncation_rates

#: Share of the cells whose codes are scanned per query where no lowest cosine bounds the search: an object
#: without a close neighbour has its nearest ones in any of them.
NEAREST_PROBES = 1.0
#: Codes a query keeps of each block for the exact comparison: scores of such objects lie close together.
NEAREST_DEPTH = 400

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def collections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "fts_corpus"), read_table(spark, sf_dir, "mm_histograms")


# --- 4: frequency of every term -------------------------------------------------


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, term, cf, df, n_records, mark) of every term of both collections."""
    corpus, histograms = collections(spark, sf_dir)
    each = term_records(corpus, histograms).select("scope", F.explode("terms").alias("t"))
    suffixes = each.select("scope", F.col("t.term").alias("suffix"), F.lit(0).alias("shared"), F.col("t.tf").alias("tf"), F.lit(1).alias("records"))  # a term is in a record's list once
    counts = count_ngrams(suffixes).withColumn("term", F.col("gram")[0]).drop("gram")
    return mark_terms(counts, record_counts(corpus, histograms))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in one or two records, or in more than 40% of them."""
    return term_frequencies(spark, sf_dir).where(F.col("mark").isNotNull()).select("scope", "term", "mark")


@query
def p4_term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term, with its mark."""
    return term_frequencies(spark, sf_dir).select("scope", "term", "cf", "df", "n_records", "mark")


@query
def p4_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every n-gram of up to three terms of fts_corpus."""
    texts = read_table(spark, sf_dir, "fts_corpus").select(F.col("rid").alias("record_id"), text_content(F.col("title"), F.col("body")).alias("text"))
    counts = count_ngrams(text_suffixes(texts, 3).withColumn("scope", F.lit("text")))
    return counts.select(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("n"), "cf", "df")


_TERMS = r"""
    words as (select 'text' as scope, rid as record_id,
                     unnest(regexp_extract_all(strip_accents(lower(coalesce(title, '') || ' ' || coalesce(body, ''))), '\p{L}+')) as term from fts_corpus),
    usable as (select * from mm_histograms where hist_tf is not null and list_sum(hist_tf) > 0),
    bins as (select modality as scope, obj_id as record_id, unnest(range(0, len(hist_tf))) as w, unnest(hist_tf) as tf from usable),
    tf as (select scope, record_id, term, count(*) as tf from words group by all
           union all select scope, record_id, w::varchar, tf from bins where tf > 0),
    n as (select 'text' as scope, count(*) as n_records from fts_corpus union all select modality, count(*) from usable group by 1),
    stats as (select scope, term, sum(tf)::bigint as cf, count(*) as df from tf group by all)"""

SQL["p4_term_frequencies"] = f"""
    with {_TERMS}
    select scope, term, cf, df, n_records, case when df <= 2 then 'rare' when df > 0.4 * n_records then 'common' end as mark
    from stats join n using (scope)"""
SQL["p4_found"] = f"select scope, term, mark from ({SQL['p4_term_frequencies']}) where mark is not null"
SQL["p4_ngrams"] = r"""
    with w as (select rid, regexp_extract_all(strip_accents(lower(coalesce(title, '') || ' ' || coalesce(body, ''))), '\p{L}+') as t from fts_corpus),
    p as (select rid, t, unnest(range(1, len(t) + 1)) as i from w),
    g as (select rid, unnest([1, 2, 3]) as n, t, i from p)
    select array_to_string(t[i : i + n - 1], ' ') as gram, n, count(*) as cf, count(distinct rid) as df
    from g where i + n - 1 <= len(t) group by 1, 2"""


# --- 5: how distinctive a term is -----------------------------------------------


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three highest-scoring terms of each record, by the collections' own tf-idf."""
    return distinctive_terms(term_records(*collections(spark, sf_dir)), top=3).select("scope", "record_id", "term")


@query
def p5_parsimonious_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three terms of each record with most mass in its parsimonious language model."""
    top = distinctive_terms(term_records(*collections(spark, sf_dir)), top=3, by="probability")
    return top.select("scope", "record_id", "term", F.round("probability", 4).alias("probability"))


SQL["p5_found"] = f"""
    with {_TERMS},
    scored as (select scope, record_id, term, round(case when scope = 'text' then (1 + log10(tf)) * log10(n_records / df::double)
                      else tf * (ln((n_records + 1) / (df + 1)::double) + 1) end, 6) as score
               from tf join stats using (scope, term) join n using (scope)),
    ranked as (select *, row_number() over (partition by scope, record_id
                      order by score desc, case when scope <> 'text' then term::int end, term) as k from scored where score > 0)
    select scope, record_id, term from ranked where k <= 3"""


SQL["p5_parsimonious_terms"] = f"""
    with recursive {_TERMS},
    total as (select scope, sum(cf)::double as total from stats group by scope),
    base as (select scope, record_id, term, tf::double as tf, cf / total as bg from tf join stats using (scope, term) join total using (scope)),
    em as (
        select scope, record_id, term, tf, bg, tf / sum(tf) over (partition by scope, record_id) as p, 0 as round, 1.0::double as moved from base
        union all
        select scope, record_id, term, tf, bg, e / total, round + 1, max(abs(e / total - p)) over (partition by scope, record_id)
        from (select *, sum(e) over (partition by scope, record_id) as total
              from (select *, tf * (0.1::double * p) / (0.1::double * p + 0.9::double * bg) as e from em where moved > 1e-6 and round < 50))),
    last as (select scope, record_id, term, arg_max(p, round) as p from em group by all),
    ranked as (select *, row_number() over (partition by scope, record_id
                      order by round(p, 9) desc, case when scope <> 'text' then term::int end, term) as k from last where round(p, 9) > 0)
    select scope, record_id, term, round(p, 4) as probability from ranked where k <= 3"""


# --- 1: most similar vectors for every vector ------------------------------------


def media_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "mm_histograms").select(F.col("modality").alias("scope"), F.col("obj_id").alias("id"), F.col("hist_tf").alias("vec"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of objects with cosine of at least 0.93, one among the five nearest of the other."""
    near = similar_objects(media_objects(spark, sf_dir), k=5, min_cosine=0.93)
    return near.select(F.least("obj_id", "other_id").alias("obj_a"), F.greatest("obj_id", "other_id").alias("obj_b")).distinct()


@query
def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five objects most alike to every object whose id is divisible by 100, out of all."""
    near = similar_objects(media_objects(spark, sf_dir), k=5, min_cosine=None, nprobe=NEAREST_PROBES, depth=NEAREST_DEPTH, only_queries="id % 100 = 0")
    return near.select("scope", "obj_id", "other_id", F.round("cosine", 6).alias("cosine"), "rank")


SQL["p1_found"] = """
    with u as (select obj_id, modality, hist_tf, sqrt(list_sum(list_transform(hist_tf, lambda v: v::double * v))) as norm
               from mm_histograms where hist_tf is not null and list_sum(hist_tf) > 0),
    pair as (select a.obj_id as a, b.obj_id as b, round(list_dot_product(a.hist_tf::double[], b.hist_tf::double[]) / (a.norm * b.norm), 9) as c
             from u a join u b on a.modality = b.modality and a.obj_id <> b.obj_id),
    ranked as (select *, row_number() over (partition by a order by c desc, b) as k from pair where c >= 0.93)
    select distinct least(a, b) as obj_a, greatest(a, b) as obj_b from ranked where k <= 5"""


# --- 3: similarity clusters -------------------------------------------------------

#: Modality: numbers of a descriptor, and the distance within which two belong together.
DESCRIPTORS = {"image": (128, 130.0), "audio": (13, 12.0)}


def descriptor_rows(spark: SparkSession, sf_dir: str, modality: str) -> DataFrame:
    d = read_table(spark, sf_dir, "media_descriptors").where(F.col("modality") == modality)
    return d.where(usable_vector(F.col("descriptor"), F.lit(DESCRIPTORS[modality][0]))).select(F.col("desc_id").alias("id"), F.col("descriptor").alias("vec"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups of five or more descriptors connected within the modality's distance."""
    parts = []
    for modality, (dim, radius) in DESCRIPTORS.items():
        assigned, _ = pivot_clusters(descriptor_rows(spark, sf_dir, modality), radius, dim, settle=False)  # groups do not depend on which pivot a member is with
        big = assigned.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
        parts.append(assigned.join(big, "group").select(F.col("id").alias("desc_id"), F.col("group").alias("cluster_id")))
    return parts[0].unionByName(parts[1])


@query
def p3_cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, medoid and three most typical descriptors of every cluster, strays being clusters of one."""
    parts = []
    for modality, (dim, radius) in DESCRIPTORS.items():
        rows = descriptor_rows(spark, sf_dir, modality)
        assigned, _ = pivot_clusters(rows, radius, dim, merge=False)
        report = describe_clusters(assigned, rows)
        parts.append(report.select(F.lit(modality).alias("modality"), "cluster", "size", "medoid", F.array_join("typical_ids", ",").alias("typical_ids")))
    return parts[0].unionByName(parts[1])


SQL["p3_found"] = """
    with recursive u as (select desc_id, modality, descriptor from media_descriptors
        where descriptor is not null and len(descriptor) = case modality when 'image' then 128 else 13 end
          and len(list_filter(descriptor, lambda v: v is null or isnan(v))) = 0),
    edge as (select a.desc_id as a, b.desc_id as b from u a join u b on a.modality = b.modality and a.desc_id <> b.desc_id
             where list_distance(a.descriptor::double[], b.descriptor::double[]) <= case a.modality when 'image' then 130 else 12 end),
    reach(a, b) as (select desc_id, desc_id from u union select r.a, e.b from reach r join edge e on r.b = e.a),
    root as (select a as desc_id, min(b) as cluster_id from reach group by a)
    select desc_id, cluster_id from root where cluster_id in (select cluster_id from root group by 1 having count(*) >= 5)"""


# --- 8: filling containers ---------------------------------------------------------


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = [(r["container_id"], r["capacity_tokens"]) for r in read_table(spark, sf_dir, "containers").select("container_id", "capacity_tokens").collect()]  # a fixed list of kinds
    return pack_texts(read_table(spark, sf_dir, "documents"), "doc_id", "text", containers)


@query
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text or piece, for each capacity of `containers`."""
    return packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used per capacity, tokens packed, and the share of room filled."""
    bins = packed(spark, sf_dir).groupBy("container_id").agg((F.max("bin") + 1).alias("bins"), F.sum("n_tokens").alias("tokens"))
    kinds = read_table(spark, sf_dir, "containers").select("container_id", "capacity_tokens")
    return bins.join(kinds, "container_id").withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6))


# --- 6: texts cut off by field limits ----------------------------------------------


def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_truncated(read_table(spark, sf_dir, "varchar_rows").select("row_id", "source", "tabla", "columna", "max_bytes", "valor"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of varchar_rows whose value was cut inside a word or a sentence."""
    return truncation(spark, sf_dir).where("cut").select("row_id")


@query
def p6_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source the share of its values that were cut."""
    return truncation_rates(truncation(spark, sf_dir))


# --- 9: evaluation texts in training text ------------------------------------------


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat an item's passage, with the item."""
    return leaks(spark, sf_dir).select("doc_id", "item_id")


@query
def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item the documents holding it and the most of its words repeated."""
    return leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("matched").alias("most_matched"), F.max("item_words").alias("item_words"))


# --- 10: personal information --------------------------------------------------------


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal information of each document, with its kind, as written."""
    return find_personal(read_table(spark, sf_dir, "documents")).select("doc_id", "kind", "found_text").distinct()


@query
def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return redact_personal(read_table(spark, sf_dir, "documents"))
