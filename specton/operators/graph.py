"""Weighted directed graphs: compaction of edge lists, transitions, and walks with restart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specton.functions.scalars import mulberry32_at
from specton.operators.lineage import cut as cut_lineage

STEPS, RESTART = 40, 0.2
#: Edges of a chunk in which a sampled walk looks for its draw.
CHUNK = 256


def clean_edges(edges: DataFrame, allowed: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """src, dst, w without light edges, empty ids, loops, and ids that aren't allowed."""
    own = edges.where((F.col("w") >= least) & (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    if allowed is not None:
        for end in ("src", "dst"):
            own = own.join(allowed.select(F.col("id").alias(end)), end, "left_semi")
    return own


def strength(edges: DataFrame) -> DataFrame:
    """id, strength: the weight of all edges at a node, either way."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("strength"))


def top_nodes(strengths: DataFrame, n: int) -> DataFrame:
    """The n strongest, ties to the larger id."""
    return strengths.orderBy(F.desc("strength"), F.desc("id")).limit(n)


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between nodes."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def top_edges(edges: DataFrame, n: int, *order) -> DataFrame:
    """The n heaviest edges, ties to the first by the columns of order (those that came first, where a column tells); all of them, as
    they came, if they are no more."""
    if edges.limit(n + 1).count() <= n:
        return edges
    return edges.orderBy(F.desc("w"), *order).limit(n)


def indexed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, idx from 0 in order of id) and the edges under those numbers.

    Numbers come from a range partitioning and the counts of its parts, not from one ordered window."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    spread = ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    first = spread.groupBy("part").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    base = first.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = spread.join(base.select("part", "base"), "part").withColumn("idx", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).select("id", "idx")
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("idx").alias(f"{end}_idx"))
    return nodes, edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), "w")


def compact(edges: DataFrame, nodes: int, most_edges: int, least: float, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole preparation: clean, keep the strongest nodes and the heaviest edges between them, number the nodes."""
    own = clean_edges(edges, allowed, least)
    kept = among(own, top_nodes(strength(own), nodes))
    return indexed(top_edges(kept, most_edges, "src", "dst"))


def transitions(edges: DataFrame) -> DataFrame:
    """src, dst, p: valid positive edges over their source's sum; parallel edges stay apart."""
    own = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("w") > 0) & (F.col("w") < float("inf")))
    return own.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).drop("w")


def neighbour_transitions(similar: DataFrame, k: int) -> DataFrame:
    """src, dst, p of the similarity graph: the k nearest of each node by max(0, s)**3 + 1e-12. similar: query_id, ref_id,
    similarity, rank."""
    w = F.pow(F.greatest(F.lit(0.0), F.col("similarity").cast("double")), F.lit(3.0)) + 1e-12
    return transitions(similar.where(F.col("rank") <= k).select(F.col("query_id").alias("src"), F.col("ref_id").alias("dst"), w.alias("w")))


def with_queries(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, src, dst, p: for each query the reference graph with the query as node -1.

    The query's own row are its k nearest. In a reference's row it is added if there is room, else it takes the place of
    the kth if it is closer. base: query_id, ref_id, similarity, rank among references; asked: query, ref_id, similarity
    of all references to each query. Only rows that the query changes are made anew; a walk reads the rest from base."""
    kth = base.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    hit = asked.join(kth, asked["ref_id"] == kth["query_id"], "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("similarity") > F.col("least")))
    touched = hit.select("query", F.col("ref_id").alias("src"), F.col("similarity").alias("to_query"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = base.select(F.col("query_id").alias("src"), F.col("ref_id").alias("dst"), "similarity", "rank")
    kept = touched.join(rows, "src").where((F.col("n") < k) | (F.col("rank") < k)).select("query", "src", "dst", "similarity")
    added = touched.select("query", "src", F.lit(-1).cast("long").alias("dst"), F.col("to_query").alias("similarity"))
    first = Window.partitionBy("query").orderBy(F.desc("similarity"), "ref_id")
    own = asked.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select("query", F.lit(-1).cast("long").alias("src"), F.col("ref_id").alias("dst"), "similarity")
    w = F.pow(F.greatest(F.lit(0.0), F.col("similarity").cast("double")), F.lit(3.0)) + 1e-12
    every = kept.unionByName(added).unionByName(own).withColumn("w", w)
    return every.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("query", "src"))).select("query", "src", "dst", "p")


def walk_step(mass: DataFrame, edges: DataFrame, restart: float, start: int = -1) -> DataFrame:
    """One step of p <- restart * e + (1 - restart) * P'p, all queries at once. mass: query, node, p; edges: query, src, dst, p."""
    moved = mass.select("query", F.col("node").alias("src"), F.col("p").alias("m")).join(edges, ["query", "src"]).groupBy("query", F.col("dst").alias("node")).agg(F.sum(F.col("m") * F.col("p") * (1 - restart)).alias("p"))
    back = mass.select("query").distinct().select("query", F.lit(start).cast("long").alias("node"), F.lit(restart).alias("p"))
    return moved.unionByName(back).groupBy("query", "node").agg(F.sum("p").alias("p"))


def walk_distributions(transitions: DataFrame, starts: DataFrame, steps: int = STEPS, restart: float = RESTART) -> DataFrame:
    """query, step, node, p: every distribution of the walk in one small graph a query. transitions: query, src, dst, p;
    starts: query, node. A node without a way out keeps its mass. The graph of a query is one group, so it has to fit a
    task; ``walk_step`` serves larger ones."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        query, start = right["query"].iloc[0], right["node"].iloc[0]
        nodes = np.unique(np.concatenate([left["src"].to_numpy(np.int64), left["dst"].to_numpy(np.int64), [start]]))
        src, dst, p = np.searchsorted(nodes, left["src"]), np.searchsorted(nodes, left["dst"]), left["p"].to_numpy(float)
        stuck = np.bincount(src, p, len(nodes)) == 0
        at = np.zeros(len(nodes))
        at[np.searchsorted(nodes, start)] = 1.0
        origin, out = at.copy(), [at]
        for _ in range(steps):
            at = restart * origin + (1 - restart) * (np.bincount(dst, p * at[src], len(nodes)) + np.where(stuck, at, 0))
            out.append(at)
        every = np.stack(out)
        step, node = np.nonzero(every > 0)
        return pd.DataFrame({"query": query, "step": step.astype(np.int32), "node": nodes[node], "p": every[step, node]})

    transitions, starts = transitions.select("query", "src", "dst", "p").toDF("query", "src", "dst", "p"), starts.select("query", "node").toDF("query", "node")
    return transitions.groupBy("query").cogroup(starts.groupBy("query")).applyInPandas(lambda a, b: run(a, b) if len(b) else pd.DataFrame({"query": [], "step": [], "node": [], "p": []}).astype({"query": "int64", "step": "int32", "node": "int64", "p": float}), "query long, step int, node long, p double")


def walk(base: DataFrame, own: DataFrame, starts: DataFrame, steps: int = STEPS, restart: float = RESTART, cut: int = 4) -> DataFrame:
    """query, node, p after all steps, as joins and sums over a graph of any size.

    base: src, dst, p, the graph that all queries share; own: query, src, dst, p, rows that for a query take the place of
    the base's for the same source; starts: query, node. A node without a way out keeps its mass. The lineage is cut by a
    checkpoint after every few steps, in the folder the session names in spark.checkpoint.dir."""
    base, own, starts = (cut_lineage(x) for x in (base.select("src", "dst", "p"), own.select("query", "src", "dst", "p"), starts.select("query", "node")))
    changed = own.select("query", "src").distinct().withColumn("is_own", F.lit(True))
    mass = starts.withColumn("p", F.lit(1.0))
    back = starts.withColumn("p", F.lit(restart))
    for k in range(1, steps + 1):
        at = mass.select("query", F.col("node").alias("src"), F.col("p").alias("m")).join(changed, ["query", "src"], "left")
        first = at.where("is_own").join(own, ["query", "src"]).select("query", F.col("dst").alias("node"), (F.col("m") * F.col("p") * (1 - restart)).alias("p"))
        rest = at.where("is_own IS NULL").join(base, "src", "left").select("query", F.coalesce("dst", "src").alias("node"), (F.col("m") * F.coalesce("p", F.lit(1.0)) * (1 - restart)).alias("p"))
        mass = first.unionByName(rest).unionByName(back).groupBy("query", "node").agg(F.sum("p").alias("p"))
        if k % cut == 0:
            mass = cut_lineage(mass)
    return mass


def _ranges(transitions: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Out-edges as ranges of a draw, in order of dst, in two levels: of each source the ends of its chunks, and of each chunk the
    ends of its edges. No row holds more than about the root of a source's edges, or CHUNK, whichever is more."""
    w = Window.partitionBy(*key, "src").orderBy("dst")
    high = F.sum("p").over(w)
    at = transitions.withColumn("high", high).withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*key, "src")))
    size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt("_n")))
    at = at.withColumn("chunk", F.floor(F.col("_k") / size).cast("int"))
    edges = at.groupBy(*key, "src", "chunk").agg(F.array_sort(F.collect_list(F.struct("high", "dst"))).alias("edges"))
    chunks = edges.select(*key, "src", "chunk", F.element_at("edges", -1)["high"].alias("high")).groupBy(*key, "src").agg(F.array_sort(F.collect_list(F.struct("high", "chunk"))).alias("chunks"))
    return chunks, edges


def sample_walks(transitions: DataFrame, walkers: DataFrame, steps: int = STEPS, restart: float = RESTART, key: list[str] | None = None) -> DataFrame:
    """walker, step, node, restarted: paths of walkers (walker, start, seed, and the columns of key) over transitions (src, dst, p, and
    the columns of key). At each step a walker draws whether it goes back to its start, and if not, along which edge; without an
    edge it stays. Draws come from a generator of the walker's own seed and the number drawn so far, so paths are the same
    under any partitioning. A step is two joins; walkers are rows, so any number of them walks at once."""
    key = key or []
    chunks, edges = (cut_lineage(x) for x in _ranges(transitions.select(*key, "src", "dst", "p"), key))
    now = cut_lineage(walkers.select(*key, "walker", "start", F.col("seed").cast("long").alias("seed")).withColumn("node", F.col("start")).withColumn("drawn", F.lit(0).cast("long")))
    out = now.select(*key, "walker", F.lit(0).alias("step"), "node", F.lit(False).alias("restarted"))
    pick = lambda c, draw: F.coalesce(F.get(F.filter(c, lambda e: e["high"] > draw), 0), F.element_at(c, -1))
    for step in range(1, steps + 1):
        back = mulberry32_at(F.col("seed"), F.col("drawn")) < restart
        at = now.withColumn("restarted", back).withColumn("draw", mulberry32_at(F.col("seed"), F.col("drawn") + 1))
        at = at.join(chunks.withColumnRenamed("src", "node"), [*key, "node"], "left").withColumn("chunk", pick(F.col("chunks"), F.col("draw"))["chunk"]).drop("chunks")
        at = at.join(edges.withColumnRenamed("src", "node"), [*key, "node", "chunk"], "left")
        moved = F.coalesce(pick(F.col("edges"), F.col("draw"))["dst"], F.col("node"))
        # Only an edge needs the second number, also where there is one way alone.
        used = F.when(F.col("restarted"), 1).otherwise(2)
        now = at.select(*key, "walker", "start", "seed", F.when(F.col("restarted"), F.col("start")).otherwise(moved).alias("node"), (F.col("drawn") + used).alias("drawn"), "restarted")
        now = cut_lineage(now)
        out = out.unionByName(now.select(*key, "walker", F.lit(step).alias("step"), "node", "restarted"))
        now = now.drop("restarted")
    return out


def walk_options(transitions: DataFrame, starts: DataFrame, restart: float = RESTART) -> DataFrame:
    """query, src, dst, p, rank: where a walk of each query goes from each node, with the way back to its start merged into an edge
    that leads there anyway; the likeliest first, ties to the smaller node. transitions: query, src, dst, p; starts: query, node."""
    start = starts.select("query", F.col("node").alias("dst"))
    sources = transitions.select("query", "src").distinct()
    nodes = sources.unionByName(transitions.select("query", F.col("dst").alias("src"))).unionByName(start.select("query", F.col("dst").alias("src"))).distinct()
    # A node that nothing leads from stays where it is.
    stuck = nodes.join(sources, ["query", "src"], "left_anti").select("query", "src", F.col("src").alias("dst"), F.lit(1.0).alias("p"))
    edges = transitions.select("query", "src", "dst", "p").unionByName(stuck).withColumn("p", F.col("p") * (1 - restart))
    back = nodes.join(start, "query").select("query", "src", "dst", F.lit(restart).alias("p"))
    own = edges.unionByName(back).groupBy("query", "src", "dst").agg(F.sum("p").alias("p")).where("p > 0")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query", "src").orderBy(F.desc("p"), "dst")))


def walk_summary(distributions: DataFrame, labels: DataFrame, start: int = -1) -> DataFrame:
    """query, step, start_mass, moved: the mass on the query and the total variation from the step before."""
    now = distributions.select("query", "step", "node", "p")
    before = now.select("query", (F.col("step") + 1).alias("step"), "node", F.col("p").alias("q"))
    last = now.groupBy("query").agg(F.max("step").alias("last"))
    both = now.join(before, ["query", "step", "node"], "full").join(last, "query").where("step <= last")
    diff = F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2
    return both.groupBy("query", "step").agg(F.sum(F.when(F.col("node") == start, F.coalesce("p", F.lit(0.0))).otherwise(0.0)).alias("start_mass"), F.when(F.col("step") > 0, diff).alias("moved"))


def walk_labels(distributions: DataFrame, labels: DataFrame) -> DataFrame:
    """query, step, label, mass, nodes, score: mass of each label over its number of references, scaled to 1 a step."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    mass = distributions.join(labels.select(F.col("ref_id").alias("node"), "label"), "node").groupBy("query", "step", "label").agg(F.sum("p").alias("mass"), F.count("*").alias("nodes"))
    per = mass.join(sizes, "label").withColumn("_s", F.col("mass") / F.col("size"))
    return per.withColumn("score", F.col("_s") / F.sum("_s").over(Window.partitionBy("query", "step"))).drop("_s", "size")
