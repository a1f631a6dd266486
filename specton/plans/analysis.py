"""Queries that SQL doesn't express: projections, shapes, walks with the query in the graph, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specton.operators import diffusion, etl, evaluate, graph, morphometrics, projection, similarity
from specton.operators.lineage import cut
from specton.plans.vectors import _COS, _E, _left_out, _rows


def sparse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projection.tags(_rows(spark, sf_dir), projection.sparse_projection(64))
    return out.select("id", F.size("tag").alias("active"), F.get("tag", F.lit(0)).alias("first"))


def dense_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projection.tags(_rows(spark, sf_dir), projection.dense_projection(64, 512))
    return out.select("id", F.size("tag").alias("active"), F.get("tag", F.lit(0)).alias("first"))


def shape_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 38 components as 19 landmarks: Procrustes distance of each row to its label's mean shape of all rows."""
    rows = _rows(spark, sf_dir).where(F.col("label").isNotNull()).select("id", "label", F.slice("vector", 1, 38).alias("v"))
    means = morphometrics.means(rows, "label")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.stack([means[x] for x in pdf["label"]])
                turned = morphometrics.turned(morphometrics.points(pdf["v"]), m)
                yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "distance": np.round(np.sqrt(((turned - m) ** 2).sum((1, 2))), 6)})

    return rows.mapInPandas(measure, "id long, label string, distance double")


def walk_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each label after 40 steps of the walk from rows 0 modulo 50, each a node of its own in the graph."""
    asked, known, base, to = _walk_graph(spark, sf_dir)
    rows = graph.with_queries(base, to, 7).select(F.col("query").alias("id"), "src", "dst", "p")
    starts = asked.select("id", F.lit(-1).cast("long").alias("node"), F.lit(1.0).alias("value"))
    mass = diffusion.gathered(graph.neighbour_transitions(base, 7), starts, known.select(F.col("id").alias("node"), "label"), "label", graph.STEPS, graph.RESTART, rows)
    per = mass.join(known.groupBy("label").agg(F.count("*").alias("size")), "label").withColumn("s", F.col("value") / F.col("size"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy("id"))
    return per.select(F.col("id").alias("query"), "label", F.round(share, 6).alias("score"))


def _walk_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows 0 modulo 50, the others, their 7-nearest graph, and every pair of a query and a reference that makes an edge."""
    rows = _rows(spark, sf_dir)
    asked, known = rows.where("id % 50 = 0"), rows.where("id % 50 <> 0")
    base = cut(similarity.neighbours(known, known, 7))
    bars = base.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= 7, F.min("similarity")).alias("bar"))
    closer = similarity.pairs_above(asked, known.join(bars, "id", "left"))
    near = similarity.neighbours(asked, known, 7).select("query_id", "ref_id", "similarity")
    to = cut(closer.unionByName(near).distinct().withColumnRenamed("query_id", "query"))
    return asked, known, base, to


TRACES_SQL = f"""WITH RECURSIVE {_E}, k AS (SELECT * FROM e WHERE id % 50 <> 0), q AS (SELECT * FROM e WHERE id % 50 = 0),
kk AS (SELECT a.id AS src, b.id AS dst, {_COS} AS s FROM k a JOIN k b ON a.id <> b.id),
bs AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank FROM kk), base AS (SELECT * FROM bs WHERE rank <= 7),
kth AS (SELECT src, count(*) AS n, min(s) AS least FROM base GROUP BY src),
qk AS (SELECT a.id AS query, b.id AS ref, {_COS} AS s FROM q a JOIN k b ON true),
hit AS (SELECT query, ref, s, coalesce(n, 0) AS n FROM qk LEFT JOIN kth ON kth.src = ref WHERE coalesce(n, 0) < 7 OR s > least),
qr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, ref) AS r FROM qk),
rows AS (
  SELECT q.id AS query, base.src, base.dst, base.s FROM q, base LEFT JOIN hit ON hit.query = q.id AND hit.ref = base.src WHERE hit.ref IS NULL OR hit.n < 7 OR base.rank < 7
  UNION ALL SELECT query, ref, -1, s FROM hit UNION ALL SELECT query, -1, ref, s FROM qr WHERE r <= 7
),
w AS (SELECT query, src, dst, power(greatest(0.0, CAST(s AS DOUBLE)), 3) + 1e-12 AS w FROM rows), t AS (SELECT query, src, dst, w / sum(w) OVER (PARTITION BY query, src) AS p FROM w),
m AS (
  SELECT 0 AS step, id AS query, -1 AS node, CAST(1.0 AS DOUBLE) AS p FROM q
  UNION ALL
  SELECT step, query, node, sum(p) AS p FROM (
    SELECT m.step + 1 AS step, m.query, t.dst AS node, 0.8 * m.p * t.p AS p FROM m JOIN t ON t.query = m.query AND t.src = m.node WHERE m.step < 40
    UNION ALL
    SELECT DISTINCT m.step + 1, m.query, -1, CAST(0.2 AS DOUBLE) FROM m WHERE m.step < 40
  ) GROUP BY step, query, node
),
l AS (SELECT query, label, sum(p) / (SELECT count(*) FROM k x WHERE x.label = k.label) AS s FROM m JOIN k ON k.id = node WHERE step = 40 GROUP BY query, label)
SELECT query, label, round(s / sum(s) OVER (PARTITION BY query), 6) AS score FROM l"""

#: Walkers of each query.
WALKERS = 100


def sampled_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often 100 seeded walkers of each row 0 modulo 50 are at a node in steps 1 to 40, in the 7-nearest graph of the other rows."""
    asked, known, base, _ = _walk_graph(spark, sf_dir)
    to = similarity.neighbours(asked, known, 7)
    edges = graph.neighbour_transitions(base, 7).unionByName(graph.neighbour_transitions(to, 7))
    walkers = asked.select((F.col("id") * WALKERS).alias("_w"), F.col("id").alias("start")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(WALKERS - 1))))
    walkers = walkers.select((F.col("_w") + F.col("k")).alias("walker"), "start", (F.col("_w") + F.col("k") + 29).alias("seed"))
    paths = graph.sample_walks(edges, walkers)
    return paths.where("step > 0").groupBy(F.floor(F.col("walker") / WALKERS).alias("query"), "node").agg(F.count("*").alias("visits"), F.count_if("restarted").alias("restarts"))


_M32 = "CAST(4294967296 AS HUGEINT)"


def _draw_sql(state: str) -> str:
    """Two lines of SELECT that turn the generator's state into its number."""
    return f"""xor(t1, (t1 + (CAST(xor(t1, t1 >> 7) AS HUGEINT) * (t1 | 61)) % {_M32})::BIGINT % 4294967296) AS t2 FROM (SELECT *, ((CAST(xor({state}, {state} >> 15) AS HUGEINT) * ({state} | 1)) % {_M32})::BIGINT AS t1"""


WALKS_SQL = f"""WITH RECURSIVE {_E}, p AS (SELECT a.id AS src, b.id AS dst, {_COS} AS similarity FROM e a JOIN e b ON b.id % 50 <> 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM p),
w AS (SELECT src, dst, power(greatest(0.0, CAST(similarity AS DOUBLE)), 3) + 1e-12 AS w FROM r WHERE rank <= 7), t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w),
g AS (SELECT src, list(dst ORDER BY dst) AS dst, list(high ORDER BY dst) AS high FROM (SELECT src, dst, sum(p) OVER (PARTITION BY src ORDER BY dst) AS high FROM t) GROUP BY src),
n AS (SELECT DISTINCT range AS n FROM range(82)),
ws AS (SELECT id AS query, id * {WALKERS} + range AS walker FROM e, range({WALKERS}) WHERE id % 50 = 0),
d AS (SELECT walker, n, CAST(xor(t2, t2 >> 14) AS DOUBLE) / 4294967296 AS u FROM (SELECT walker, n, {_draw_sql("s")} FROM (SELECT walker, n, (walker + 29 + (n + 1) * 1831565813) % 4294967296 AS s FROM ws, n)))),
m AS (
  SELECT 0 AS step, query, walker, query AS node, 0 AS drawn, false AS restarted FROM ws
  UNION ALL
  SELECT m.step + 1, m.query, m.walker, CASE WHEN a.u < 0.2 THEN m.query ELSE g.dst[least(len(g.dst), len(list_filter(g.high, lambda h: h <= b.u)) + 1)] END, m.drawn + CASE WHEN a.u < 0.2 THEN 1 ELSE 2 END, a.u < 0.2
  FROM m JOIN g ON g.src = m.node JOIN d a ON a.walker = m.walker AND a.n = m.drawn JOIN d b ON b.walker = m.walker AND b.n = m.drawn + 1 WHERE m.step < 40
)
SELECT query, node, count(*) AS visits, count(CASE WHEN restarted THEN 1 END) AS restarts FROM m WHERE step > 0 GROUP BY query, node"""


def walk_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the walks of rows 0 modulo 50 go from their own node and its neighbours, the likeliest first."""
    asked, known, base, to = _walk_graph(spark, sf_dir)
    first = similarity.neighbours(asked, known, 7)
    own = graph.neighbour_transitions(first, 7).withColumn("query", F.col("src"))
    around = first.select(F.col("query_id").alias("query"), F.col("ref_id").alias("src")).join(graph.neighbour_transitions(base, 7), "src")
    out = graph.walk_options(own.unionByName(around.select(*own.columns)), asked.select(F.col("id").alias("query"), F.col("id").alias("node")))
    sources = own.select("query", "src").unionByName(around.select("query", "src")).distinct()
    return out.join(sources, ["query", "src"], "left_semi").select("query", "src", "dst", F.round("p", 6).alias("p"), "rank")


OPTIONS_SQL = f"""WITH {_E}, p AS (SELECT a.id AS src, b.id AS dst, {_COS} AS similarity FROM e a JOIN e b ON b.id % 50 <> 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM p),
w AS (SELECT src, dst, power(greatest(0.0, CAST(similarity AS DOUBLE)), 3) + 1e-12 AS w FROM r WHERE rank <= 7), t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w),
n AS (SELECT src AS query, src FROM t WHERE src % 50 = 0 UNION SELECT src, dst FROM t WHERE src % 50 = 0),
o AS (SELECT query, src, dst, 0.8 * p AS p FROM n JOIN t USING (src) UNION ALL SELECT query, src, query, 0.2 FROM n),
s AS (SELECT query, src, dst, sum(p) AS p FROM o GROUP BY ALL)
SELECT query, src, dst, round(p, 6) AS p, CAST(row_number() OVER (PARTITION BY query, src ORDER BY p DESC, dst) AS INTEGER) AS rank FROM s"""


def graph_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings put into the graph of suppliers and parts that were shipped together, weighed by quantity: the sketch's ten first bins."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.pmod("l_suppkey", F.lit(RESERVOIR)).alias("src"), F.pmod(F.col("l_partkey") * 7 + 3, F.lit(RESERVOIR)).alias("dst")).agg(F.sum("l_quantity").cast("double").alias("w"))
    out = diffusion.reservoir(_rows(spark, sf_dir), lines, RESERVOIR, bins=10)
    return out.select("id", F.transform("sketch", lambda x: F.round(x, 6)).alias("sketch")).select("id", *[F.get("sketch", F.lit(k)).alias(f"bin{k}") for k in range(10)])


RESERVOIR = 400
RESERVOIR_SQL = f"""WITH RECURSIVE {_E}, l AS (SELECT l_suppkey % {RESERVOIR} AS src, (l_partkey * 7 + 3) % {RESERVOIR} AS dst, CAST(sum(l_quantity) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM l WHERE w > 0),
x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e),
z AS (SELECT id, (((2 * i + CASE WHEN x > 0 THEN 1 ELSE 2 END) * 2654435761) % 4294967296) % {RESERVOIR} AS node, abs(x) / sum(abs(x)) OVER (PARTITION BY id) AS x FROM x WHERE x <> 0),
s AS (SELECT id, node, sum(x) AS x FROM z GROUP BY ALL),
a AS (SELECT n.range AS src, coalesce(t.dst, n.range) AS dst, coalesce(t.p, 1.0) AS p FROM range({RESERVOIR}) n LEFT JOIN t ON t.src = n.range),
m AS (
  SELECT 0 AS step, id, node, x FROM s
  UNION ALL
  SELECT step, id, node, sum(x) AS x FROM (
    SELECT m.step + 1 AS step, m.id, a.dst AS node, 0.82 * m.x * a.p AS x FROM m JOIN a ON a.src = m.node WHERE m.step < 5
    UNION ALL SELECT k.step + 1, s.id, s.node, 0.18 * s.x FROM s JOIN (SELECT DISTINCT step, id FROM m WHERE step < 5) k ON k.id = s.id
  ) GROUP BY step, id, node
),
b AS (SELECT id, (((node + 11) * 2246822519) % 4294967296) % 10 AS bin, sum(x) AS x FROM m WHERE step = 5 GROUP BY ALL),
u AS (SELECT id, bin, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM b)
SELECT e.id, {", ".join(f"round(coalesce(max(CASE WHEN bin = {k} THEN x END), 0), 6) AS bin{k}" for k in range(10))} FROM e LEFT JOIN u ON u.id = e.id GROUP BY e.id"""


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bootstrap(evaluate.animals(_left_out(spark, sf_dir)))


def landmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: F.struct((F.get("vector", 2 * i) * 100).alias("x"), (F.get("vector", 2 * i + 1) * 100).alias("y")))
    return etl.landmark_lines(_rows(spark, sf_dir).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("file"), v.alias("points")), "points", "file", 19)


def landmark_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """19 points of every vector, the first missing where its x is negative, through a similarity of four more components; labelled rows
    count as confirmed."""
    e = lambda i: F.get("embedding", F.lit(i) if isinstance(i, int) else i).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: F.struct(F.when((i > 0) | (e(0) >= 0), e(2 * i)).alias("x"), e(2 * i + 1).alias("y")))
    matrix = F.array(e(38) + 2, -e(39), e(40), e(39), e(38) + 2, e(41), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL")
    block = rows.select("vec_id", etl.landmark_block(points, matrix, F.col("label").isNotNull()).alias("block"))
    total = F.aggregate("block", F.lit(0.0), lambda a, x: a + x)
    return block.select("vec_id", F.when(F.col("block").isNull(), 0).otherwise(F.size("block")).cast("long").alias("n"), F.round(F.get("block", F.lit(0)), 6).alias("first_x"), F.round(F.get("block", F.lit(37)), 6).alias("last_y"), F.round(total, 4).alias("total"))


BLOCKS_SQL = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT e.*, CAST(i AS INTEGER) AS i, CASE WHEN i > 0 OR v[1] >= 0 THEN v[2 * i + 1] END AS x, v[2 * i + 2] AS y FROM e, range(19) AS r(i)),
c AS (SELECT vec_id, label, i, (v[39] + 2) * x - v[40] * y + v[41] AS cx, v[40] * x + (v[39] + 2) * y + v[42] AS cy FROM p),
b AS (SELECT vec_id, count(cx) = 19 AND count(cy) = 19 AND max(label) IS NOT NULL AS whole, max(CASE WHEN i = 0 THEN cx END) AS fx, max(CASE WHEN i = 18 THEN cy END) AS ly, sum(cx) + sum(cy) AS total FROM c GROUP BY vec_id)
SELECT vec_id, CAST(CASE WHEN whole THEN 38 ELSE 0 END AS BIGINT) AS n, CASE WHEN whole THEN round(fx, 6) END AS first_x, CASE WHEN whole THEN round(ly, 6) END AS last_y, CASE WHEN whole THEN round(total, 4) END AS total FROM b
"""


QUERIES = {
    "landmark_blocks": (landmark_blocks, BLOCKS_SQL),
    "sparse_tags": (sparse_tags, None), "dense_tags": (dense_tags, None), "shape_distances": (shape_distances, None), "walk_traces": (walk_traces, TRACES_SQL),
    "sampled_walks": (sampled_walks, WALKS_SQL), "walk_options": (walk_options, OPTIONS_SQL), "graph_reservoir": (graph_reservoir, RESERVOIR_SQL),
    "bootstrap_interval": (bootstrap_interval, None), "landmark_lines": (landmark_lines, None),
}
