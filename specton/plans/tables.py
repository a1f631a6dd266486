"""Queries over the relational tables: provenance, readiness, graph preparation, run lengths, frames, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specton.functions import scalars
from specton.operators import etl, evaluate, graph, references, similarity
from specton.streaming import frames


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    return references.distinct_views(docs, "source", "key", "doc_id").select("source", "key", "doc_id")


def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.label_conflicts(_t(spark, sf_dir, "documents"), "source", "lang")


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.withColumn("sex", F.when(F.col("toxic") == 1, "F").when(F.col("toxic") == 0, "M")).withColumn("series", F.col("doc_id") % 7)
    return references.readiness(rows, "lang", "source", "series", "quality", "sex")


def reused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("hash", F.sha2("text", 256))
    return references.reused_sources(docs, "hash", "source")


def fingerprint_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n and value of the order-independent fingerprint of documents, under another dealing of the rows, and without one of them."""
    ids = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    least = ids.agg(F.min("id").alias("id"))
    cases = {"whole": ids, "dealt": ids.repartition(5, "id"), "less": ids.join(least, "id", "left_anti")}
    out = None
    for name, rows in cases.items():
        own = references.fingerprint(rows, "id").select(F.lit(name).alias("rows"), "n", "fingerprint")
        out = own if out is None else out.unionByName(own)
    return out


def reconciled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a returned line against finished orders: what only one side has."""
    returned = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    finished = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return references.reconcile(returned, finished, "key")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    return references.representative(rows, "nation", "name", "v1:")


def overlap_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out documents (every fifth) whose text, by hash, is also that of another document, by source: none should be."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    train = docs.where("doc_id % 5 <> 0").select("hash")
    return docs.where("doc_id % 5 = 0").join(train, "hash", "left_semi").groupBy("source").agg(F.count("*").alias("shared"))


def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _t(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.lit("stored").alias("origin"))
    incoming = _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("incoming").alias("origin"))
    return references.append_new(stored, incoming)


def last_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order the last line, by number, part, supplier and day."""
    rows = _t(spark, sf_dir, "lineitem").withColumn("revision", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    return references.last_revision(rows, "l_orderkey", "revision").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def shared_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return part.where("p_partkey % 4 = 0").select("p_brand").intersect(part.where("p_partkey % 4 <> 0").select("p_brand"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("w"))


_EDGES = "ed AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, sum(l_quantity) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), ce AS (SELECT * FROM ed WHERE w >= 20)"
_STRONG = f"{_EDGES}, st AS (SELECT id, sum(w) AS strength FROM (SELECT src AS id, w FROM ce UNION ALL SELECT dst, w FROM ce) GROUP BY id), tn AS (SELECT * FROM st ORDER BY strength DESC, id DESC LIMIT 300)"
_KEPT = f"{_STRONG}, ke AS (SELECT * FROM ce WHERE src IN (SELECT id FROM tn) AND dst IN (SELECT id FROM tn)), te AS (SELECT * FROM ke ORDER BY w DESC, src, dst LIMIT 2000), nd AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT src AS id FROM te UNION SELECT dst FROM te))"


def node_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strength(graph.clean_edges(_edges(spark, sf_dir), None, 20.0))


def strongest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_nodes(node_strength(spark, sf_dir), 300)


def compact_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.compact(_edges(spark, sf_dir), 300, 2000, 20.0)[1]


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.compact(_edges(spark, sf_dir), 300, 2000, 20.0)[0]


def graph_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitions(graph.clean_edges(_edges(spark, sf_dir), None, 20.0)).select("src", "dst", F.round("p", 8).alias("p"))


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem")
    half, most = (similarity.order_statistic(rows, "l_returnflag", "l_extendedprice", q).withColumnRenamed("l_extendedprice", n) for q, n in ((0.5, "median"), (0.9, "p90")))
    return half.join(most, "l_returnflag")


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("value") > 50).cast("int").alias("bit")).where("bit IS NOT NULL")
    return etl.run_lengths(rows, "user_id", "at", "bit")


def frame_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.statistics(_t(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("noise", 6).alias("noise"))


def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.count_windows(_t(spark, sf_dir, "events"), "event_id", "value", 64).select("window", "n", F.round("mean", 6).alias("mean"))


def running_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.meters(_t(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id").select("event_id", F.round("share", 6).alias("share"))


def width_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return etl.width_profile(rows, "l_returnflag", "l_quantity", "l_extendedprice").select("l_returnflag", "bin", F.round("width", 4).alias("width"))


def first_middle_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.first_middle_last(_t(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey").select("c_nationkey", "c_mktsegment", "c_custkey")


def colour_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    r, g, b = (F.col("p_partkey") * k % 256 for k in (7, 13, 29))
    lab = scalars.rgb_to_lab(r, g, b)
    return p.select("p_partkey", *[F.round(x, 5).alias(n) for x, n in zip(lab, ("l", "a", "b"), strict=True)], F.round(scalars.luminance(r, g, b), 6).alias("y"))


_LIN = lambda k: f"CASE WHEN (p_partkey * {k} % 256) / 255.0 <= 0.04045 THEN (p_partkey * {k} % 256) / 255.0 / 12.92 ELSE power(((p_partkey * {k} % 256) / 255.0 + 0.055) / 1.055, 2.4) END"
LAB_SQL = f"""WITH c AS (SELECT p_partkey, CAST({_LIN(7)} AS DOUBLE) AS r, CAST({_LIN(13)} AS DOUBLE) AS g, CAST({_LIN(29)} AS DOUBLE) AS b FROM part),
x AS (SELECT p_partkey, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS z FROM c),
f AS (SELECT p_partkey, CASE WHEN x > 216.0 / 24389 THEN cbrt(x) ELSE (24389.0 / 27 * x + 16) / 116 END AS x, CASE WHEN y > 216.0 / 24389 THEN cbrt(y) ELSE (24389.0 / 27 * y + 16) / 116 END AS y, CASE WHEN z > 216.0 / 24389 THEN cbrt(z) ELSE (24389.0 / 27 * z + 16) / 116 END AS z FROM x)
SELECT p_partkey, round(116 * y - 16, 5) AS l, round(500 * (x - y), 5) AS a, round(200 * (y - z), 5) AS b, round(CAST(0.2126 AS DOUBLE) * (p_partkey * 7 % 256) + CAST(0.7152 AS DOUBLE) * (p_partkey * 13 % 256) + CAST(0.0722 AS DOUBLE) * (p_partkey * 29 % 256), 6) AS y FROM f"""


def hashed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", scalars.multiplicative_hash(2 * F.col("p_partkey") + 1, 2654435761, 512).alias("cell"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 5 == 0, "x").otherwise((F.col("p_partkey") * 37).cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.clamp_setting(text, 128, 8192, 2048).alias("cells"))


def novel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select(F.col("lang").alias("label"), F.col("source").alias("group"), (F.col("n_chars") > 200).alias("valid"), (F.col("doc_id") % 3 != 0).alias("unknown"))
    return evaluate.novel_rejection(rows).select("label", "groups", "valid", "rejected", F.round("rate", 6).alias("rate"))


def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("p_partkey") - 1000) / 2
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.round_half_up(x).cast("long").alias("up"), scalars.round_clamped(x).alias("clamped"))


_DIGITS = lambda seed: f"sum(CAST('0x' || md5('{seed}:' || id)[1:15] AS HUGEINT))"

QUERIES = {
    "distinct_views": (distinct_views, "SELECT source, sha256(coalesce(text, '')) AS key, max(doc_id) AS doc_id FROM documents GROUP BY ALL"),
    "label_conflicts": (label_conflicts, "SELECT source, count(DISTINCT lang) AS labels FROM documents GROUP BY source HAVING count(DISTINCT lang) <> 1 OR source IS NULL OR trim(source) = ''"),
    "readiness": (readiness, """SELECT lang, count(DISTINCT source) AS groups, count(*) AS rows, count(quality) AS with_landmarks, count(CASE WHEN toxic = 1 THEN 1 END) AS females,
count(CASE WHEN toxic = 0 THEN 1 END) AS males, count(CASE WHEN toxic IS NULL OR toxic NOT IN (0, 1) THEN 1 END) AS unknown_sex, count(DISTINCT d.doc_id % 7) AS series,
CASE WHEN count(DISTINCT source) >= 10 THEN 'ready' WHEN count(DISTINCT source) >= 5 THEN 'weak' ELSE 'insufficient' END AS status FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY lang"""),
    "reused_sources": (reused_sources, "SELECT sha256(text) AS hash, count(DISTINCT source) AS groups FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1"),
    "fingerprint_invariance": (fingerprint_invariance, f"""WITH r AS (SELECT unnest(['whole', 'dealt', 'less']) AS rows), d AS (SELECT rows, CAST(doc_id AS VARCHAR) AS id FROM r, documents WHERE rows <> 'less' OR CAST(doc_id AS VARCHAR) <> (SELECT min(CAST(doc_id AS VARCHAR)) FROM documents))
SELECT rows, count(*) AS n, sha256(CAST({_DIGITS(1)} AS VARCHAR) || ':' || CAST({_DIGITS(2)} AS VARCHAR)) AS fingerprint FROM d GROUP BY rows"""),
    "reconciled_keys": (reconciled_keys, """WITH a AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F')
SELECT key, 'left' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT DISTINCT key, 'right' FROM b WHERE key NOT IN (SELECT key FROM a)"""),
    "representatives": (representatives, "SELECT nation, name FROM (SELECT c_nationkey AS nation, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('v1:' || c_name), c_name) AS k FROM customer) WHERE k = 1"),
    "overlap_guard": (overlap_guard, "SELECT source, count(*) AS shared FROM documents WHERE doc_id % 5 = 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 <> 0) GROUP BY source"),
    "append_new": (append_new, "SELECT c_custkey AS id, 'stored' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'incoming' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0"),
    "last_revision": (last_revision, "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS k FROM lineitem) WHERE k = 1"),
    "shared_series": (shared_series, "SELECT p_brand FROM part WHERE p_partkey % 4 = 0 INTERSECT SELECT p_brand FROM part WHERE p_partkey % 4 <> 0"),
    "node_strength": (node_strength, f"WITH {_STRONG} SELECT id, strength FROM st"),
    "strongest_nodes": (strongest_nodes, f"WITH {_STRONG} SELECT id, strength FROM tn"),
    "compact_graph": (compact_graph, f"WITH {_KEPT} SELECT a.idx AS src, b.idx AS dst, w FROM te JOIN nd a ON a.id = src JOIN nd b ON b.id = dst"),
    "graph_nodes": (graph_nodes, f"WITH {_KEPT} SELECT id, idx FROM nd"),
    "graph_transitions": (graph_transitions, f"WITH {_EDGES} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 8) AS p FROM ce WHERE w > 0"),
    "order_statistics": (order_statistics, "WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS x FROM lineitem GROUP BY 1) SELECT l_returnflag, x[CAST(floor(len(x) * 0.5) AS INTEGER) + 1] AS median, x[CAST(floor(len(x) * 0.9) AS INTEGER) + 1] AS p90 FROM s"),
    "run_lengths": (run_lengths, """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS bit FROM events WHERE value IS NOT NULL),
n AS (SELECT *, CASE WHEN bit <> lag(bit, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
c AS (SELECT user_id, CAST(run AS INTEGER) AS run, CAST(max(bit) AS INTEGER) AS bit, count(*) AS length FROM r GROUP BY user_id, run)
SELECT * FROM c UNION ALL SELECT user_id, 0, 0, 0 FROM c GROUP BY user_id HAVING min(run) = 1"""),
    "frame_statistics": (frame_statistics, "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS noise FROM events GROUP BY 1"),
    "frame_windows": (frame_windows, "SELECT event_id // 64 AS \"window\", count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "running_maximum": (running_maximum, "SELECT event_id, round(value / CASE WHEN max(value) OVER w = 0 THEN NULL ELSE max(value) OVER w END, 6) AS share FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    "width_profile": (width_profile, """WITH b AS (SELECT l_returnflag, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem GROUP BY 1),
x AS (SELECT l_returnflag, CAST(least(39, floor(coalesce((l_quantity - a) / nullif(b - a, 0), 0) * 40)) AS INTEGER) AS bin, l_extendedprice AS p FROM lineitem JOIN b USING (l_returnflag))
SELECT l_returnflag, bin, round(max(p) - min(p), 4) AS width FROM x GROUP BY ALL"""),
    "first_middle_last": (first_middle_last, "SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE k = 1 OR k = n // 2 + 1 OR k = n"),
    "colour_lab": (colour_lab, LAB_SQL),
    "hashed_cells": (hashed_cells, "SELECT p_partkey, CAST((CAST(2 * p_partkey + 1 AS HUGEINT) * 2654435761 % 4294967296) % 512 AS BIGINT) AS cell FROM part"),
    "settings": (settings, "SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 0 THEN 2048 ELSE greatest(128, least(8192, p_partkey * 37)) END AS INTEGER) AS cells FROM part"),
    "novel_labels": (novel_labels, """WITH g AS (SELECT lang AS label, source, bool_and(n_chars > 200) AS valid, bool_and(doc_id % 3 <> 0) AS unknown FROM documents GROUP BY ALL)
SELECT label, count(*) AS groups, count(CASE WHEN valid THEN 1 END) AS valid, count(CASE WHEN valid AND unknown THEN 1 END) AS rejected, round(count(CASE WHEN valid AND unknown THEN 1 END) / CAST(nullif(count(CASE WHEN valid THEN 1 END), 0) AS DOUBLE), 6) AS rate FROM g GROUP BY label"""),
    "rounding": (rounding, "SELECT p_partkey, CAST(floor((p_partkey - 1000) / 2.0 + 0.5) AS BIGINT) AS up, CAST(least(greatest(round_even((p_partkey - 1000) / 2.0, 0), 0), 255) AS INTEGER) AS clamped FROM part"),
}
