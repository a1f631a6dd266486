"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A document and an item are taken as five-word shingles, hashed to 64 bits. Windows of documents have the sizes of items;
they are placed where a run of an item's shingles begins, as the item would lie there: a window that is similar to an
item shares a shingle with it, so this loses nothing and spares a fingerprint at every word for every size. Distinct
windows get a 128-bit SimHash of weighted shingles, and what items they resemble is found by the fingerprints alone,
whichever item they were placed by. Items are indexed under 8 blocks of 16 bits, each value with up to three bits
flipped as well: by the pigeonhole principle all fingerprints within 31 bits meet in a block. Pairs within that radius
and of total weights that can be similar are verified by the exact weighted Jaccard similarity of their shingles, a
shingle weighing 1 to 2 by how few items hold it (none counts as one).

The items' shingles are broadcast while they are at most ``ANCHORS``; a larger benchmark is taken in parts by a hash of
the shingle, with a pass over the documents for each. Joins without a key here have one side of one row.

Defined results: null texts and those without words have no shingles and match nothing, on either side; a text of one to four
words is a single shingle of all its words, so a short item is found in a document that says nothing else; items of the same
words are one, under the smallest item_id; repeated rows of a document give its links once; of equally similar windows
the first is given; links of rows with a null doc_id come under null; an empty table gives no rows. Extra columns are not
read. ``clean`` goes by each row's text, whatever its doc_id: null and repeated ids keep and lose no other rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specton.llm.common import staged, unused

THRESHOLD = 0.8
RADIUS = 31
#: Blocks of a fingerprint, and bits of one that an item is also found under if they differ: RADIUS is under BLOCKS * (FLIPS + 1).
BLOCKS = 8
FLIPS = 3
#: Item shingles that one pass broadcasts: some 60 bytes each.
ANCHORS = 500_000
#: Shingles weigh this at least, when all items hold them, and less than twice as much when few do.
LEAST = 1000


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingles(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with their text replaced by sh, the hashes of its five-word runs in order, or of all words if there are fewer.

    No filter may stand on _w or sh here: it would be pushed down to the scan and take each text apart again.
    """
    w = F.col("_w")
    own = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    return rows.withColumn("_w", _words(F.coalesce(F.col(text).cast("string"), F.lit("")))).withColumn("sh", F.when(F.size("_w") >= 5, own).when(F.get("_w", F.lit(0)) != "", F.array(F.xxhash64(F.size("_w"), F.array_join("_w", " ")))).otherwise(F.array().cast("array<long>"))).drop(text, "_w")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, sh: one item for each distinct sequence of words."""
    return _shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")).groupBy("sh").agg(F.min("item_id").alias("item_id")).where(F.size("sh") > 0).select("item_id", "sh")


def _weight(df: Column, n: Column) -> Column:
    return (LEAST + F.floor(LEAST * F.log((n + 1) / (df + 1)) / F.log(n + 1.0) + 0.5)).cast("long")


def _weights(items: DataFrame) -> DataFrame:
    """s, weight of each shingle of the items, as an integer; and a row with s null for shingles that no item holds,
    which weigh like those of a single one."""
    df = items.select("item_id", F.explode(F.array_distinct("sh")).alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    n = items.agg(F.count("*").alias("n")).where("n > 0")
    rare = n.select(F.lit(None).cast("long").alias("s"), F.lit(1).cast("long").alias("df"))
    return df.unionByName(rare).join(F.broadcast(n)).select("s", _weight(F.col("df"), F.col("n")).alias("weight"))


def _counted(rows: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """key, s, c, weight: how often each shingle occurs under the key."""
    counts = rows.select(key, F.explode("sh").alias("s")).groupBy(key, "s").agg(F.count("*").alias("c"))
    rare = weights.where("s IS NULL").select(F.col("weight").alias("_rare"))
    return counts.join(weights, "s", "left").join(F.broadcast(rare)).select(key, "s", "c", F.coalesce("weight", "_rare").alias("weight"))


def _fingerprints(counted: DataFrame, key: str) -> DataFrame:
    """key, total weight and the two halves f0, f1 of the fingerprint."""
    terms = counted.select(key, (F.col("c") * F.col("weight")).alias("w"), F.col("s").alias("h0"), F.xxhash64("s").alias("h1"))
    votes = [F.expr(f"sum(if(shiftright({h}, {b}) & 1 = 1, w, -w))").alias(f"{h}_{b}") for h in ("h0", "h1") for b in range(64)]
    sums = terms.groupBy(key).agg(F.sum("w").alias("total"), *votes)
    half = lambda h: reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"{h}_{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)])
    return sums.select(key, "total", half("h0").alias("f0"), half("h1").alias("f1"))


def _blocks() -> Column:
    """The block values of a fingerprint, in order."""
    return F.array(*[F.shiftrightunsigned(f"f{k // 4}", 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(BLOCKS)])


def _windows(docs: DataFrame, items: DataFrame, parts: int) -> DataFrame:
    """doc_id, start, sh: item-sized windows of documents where a run of an item's shingles begins."""
    anchors = items.select("item_id", F.size("sh").alias("n"), "sh", F.posexplode("sh").alias("at", "h")).select("item_id", "n", "at", "h", F.when(F.col("at") > 0, F.get("sh", F.col("at") - 1)).alias("prev")).drop("item_id").distinct()
    found = None
    for part in range(parts):
        own = anchors if parts == 1 else anchors.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(parts)) == part)
        rows = _shingles(docs).select("doc_id", "sh", F.posexplode_outer("sh").alias("pos", "h")).join(F.broadcast(own), "h")
        rows = rows.where(F.col("prev").isNull() | (F.col("pos") == 0) | (F.get("sh", F.col("pos") - 1) != F.col("prev")))
        start = F.col("pos") - F.col("at")
        first = F.greatest(start, F.lit(0))
        rows = rows.select("doc_id", first.alias("start"), F.slice("sh", first + 1, F.col("n") + F.least(start, F.lit(0))).alias("sh"))
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def links(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start_word, similarity: for each document and item in it, the best window."""
    return _links(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, threshold)


def _links(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """The links of docs (doc_id of any type, text)."""
    items = staged(_items(benchmark))
    n = items.agg(F.coalesce(F.sum(F.size("sh")), F.lit(0)).alias("n")).first()["n"]
    weights = staged(_weights(items))
    windows = staged(_windows(docs, items, max(1, -(-n // ANCHORS))).withColumn("wid", F.md5(F.array_join(F.col("sh").cast("array<string>"), ",").cast("binary"))))
    distinct = windows.groupBy("wid").agg(F.first("sh").alias("sh"))
    counted = staged(_counted(distinct, "wid", weights))
    item_counts = staged(_counted(items, "item_id", weights))
    w = staged(_fingerprints(counted, "wid"))
    i = staged(_fingerprints(item_counts, "item_id"))
    flips = F.array(*[F.lit(sum(1 << b for b in own)) for n in range(FLIPS + 1) for own in combinations(range(16), n)])
    index = i.select("item_id", F.col("total").alias("item_total"), F.col("f0").alias("g0"), F.col("f1").alias("g1"), F.posexplode(_blocks()).alias("block", "value")).withColumn("value", F.explode(F.transform(flips, lambda x: F.col("value").bitwiseXOR(x))))
    probes = w.select("wid", "total", "f0", "f1", F.posexplode(_blocks()).alias("block", "value"))
    distance = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1")))
    alike = (F.least("total", "item_total") >= (threshold - 1e-9) * F.greatest("total", "item_total")) & (distance <= RADIUS)
    # The index has some 5600 rows an item: too many to broadcast.
    near = probes.join(index.hint("merge"), ["block", "value"]).where(alike).select("wid", "total", "item_id", "item_total").distinct()
    shared = near.join(counted, "wid").join(item_counts.select("item_id", "s", F.col("c").alias("item_c")), ["item_id", "s"])
    both = shared.groupBy("wid", "item_id", "total", "item_total").agg(F.sum(F.least("c", "item_c") * F.col("weight")).alias("both"))
    similarity = F.col("both") / (F.col("total") + F.col("item_total") - F.col("both"))
    passed = both.select("wid", "item_id", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    best = windows.select("doc_id", "start", "wid").join(passed, "wid").groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.start").cast("int").alias("start_word"), F.round(-F.col("m.s"), 6).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns."""
    key = unused(docs, "key")
    rows = docs.withColumn(key, F.unhex(F.md5(F.col("text").cast("string").cast("binary"))))
    found = _links(rows.select(F.col(key).alias("doc_id"), "text").where(F.col("text").isNotNull()), benchmark, threshold)
    return rows.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


SQL = f"""
WITH w AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL
), dw AS (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END AS sh FROM w WHERE w[1] <> ''
), iw AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL
), it AS (
  SELECT min(item_id) AS item_id, sh FROM (SELECT item_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END AS sh FROM iw WHERE w[1] <> '') GROUP BY sh
), isn AS (
  SELECT item_id, len(sh) AS n, unnest(sh) AS s, generate_subscripts(sh, 1) - 1 AS o FROM it
), n AS (SELECT count(*) AS n FROM it),
wt AS (
  SELECT s, {LEAST} + CAST(floor({LEAST} * ln((max(n.n) + 1) / (count(DISTINCT item_id) + 1)) / ln(max(n.n) + 1.0) + 0.5) AS BIGINT) AS weight FROM isn, n GROUP BY s
), rare AS (
  SELECT {LEAST} + CAST(floor({LEAST} * ln((n + 1) / 2) / ln(n + 1.0) + 0.5) AS BIGINT) AS rare FROM n
), dsn AS (
  SELECT doc_id, sh, unnest(sh) AS s, generate_subscripts(sh, 1) - 1 AS p FROM dw
), starts AS (
  SELECT DISTINCT d.doc_id, i.n, d.p - i.o AS start, d.sh FROM dsn d JOIN isn i ON d.s = i.s
), win AS (
  SELECT DISTINCT doc_id, greatest(start, 0) AS start, sh[greatest(start, 0) + 1 : start + n] AS sh FROM starts
), wc AS (
  SELECT doc_id, start, len(sh) AS size, s, count(*) AS c FROM (SELECT doc_id, start, sh, unnest(sh) AS s FROM win) GROUP BY ALL
), ic AS (
  SELECT item_id, s, count(*) AS c FROM isn GROUP BY ALL
), itot AS (
  SELECT item_id, sum(c * weight) AS t FROM ic JOIN wt USING (s) GROUP BY item_id
), wtot AS (
  SELECT doc_id, start, size, CAST(sum(c * coalesce(weight, rare)) AS DOUBLE) AS t FROM wc CROSS JOIN rare LEFT JOIN wt USING (s) GROUP BY ALL
), sim AS (
  SELECT wc.doc_id, wc.start, wc.size, ic.item_id, CAST(sum(least(wc.c, ic.c) * weight) AS DOUBLE) AS inter FROM wc JOIN ic USING (s) JOIN wt USING (s) GROUP BY ALL
), r AS (
  SELECT doc_id, item_id, start, inter / (wtot.t + itot.t - inter) AS similarity FROM sim JOIN wtot USING (doc_id, start, size) JOIN itot USING (item_id)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM r WHERE similarity >= {THRESHOLD}
)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, round(similarity, 6) AS similarity FROM best WHERE k = 1
"""
