"""Sources: CSV, id lists, edge lists, graph and reference JSON, images and meshes; each with its checks."""

from __future__ import annotations

import base64
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specton.operators.references import ContractError, assert_none

#: The most pixels of an image, and nodes and edges of an imported graph.
MOST_PIXELS, MOST_NODES, MOST_EDGES = 40_000_000, 60_000, 400_000
#: Names of the packed number types and what they are.
TYPED = {"Float32Array": "<f4", "Float64Array": "<f8", "Int32Array": "<i4", "Uint8Array": "u1", "Uint8ClampedArray": "u1"}


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, quoted line ends, and blanks around headers and values taken off; a byte order mark is skipped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def require_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return rows


def edges(spark: SparkSession, path: str, src: str, dst: str, weight: str) -> DataFrame:
    """src, dst, w of a connectivity CSV; a weight that isn't a number drops its row."""
    rows = require_columns(csv(spark, path), [src, dst, weight])
    return rows.select(F.trim(src).alias("src"), F.trim(dst).alias("dst"), F.col(weight).try_cast("double").alias("w")).where("w IS NOT NULL")


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (idx, id) and edges (src, dst, w; 1 where none is given) of a graph file within its bounds."""
    schema = "format string, nodes array<string>, edges array<array<double>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    assert_none(doc.agg(F.count_if(F.col("nodes").isNull() | F.col("edges").isNull()).alias("without_nodes_or_edges"), F.count_if(F.size("nodes") > MOST_NODES).alias("too_many_nodes"), F.count_if(F.size("edges") > MOST_EDGES).alias("too_many_edges")))
    nodes = doc.select(F.posexplode("nodes").alias("idx", "id"))
    rows = doc.select(F.explode("edges").alias("e"))
    at = lambda k: F.get("e", F.lit(k)).cast("long")
    return nodes, rows.select(at(0).alias("src"), at(1).alias("dst"), F.coalesce(F.get("e", F.lit(2)), F.lit(1.0)).alias("w"))


def references_json(spark: SparkSession, path: str, version: str, preprocessing: str) -> DataFrame:
    """Usable rows of a reference file: of the current versions and with a label. A list or an envelope of them."""
    rows = spark.read.option("multiLine", True).json(path)
    if "references" in rows.columns:
        rows = rows.select(F.explode("references").alias("r")).select("r.*")
    return rows.where((F.col("featureVersion") == version) & (F.col("preprocessingVersion") == preprocessing) & (F.length(F.trim("species")) > 0))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, width, height and rgba of images up to the most pixels. The reader gives blue first; it is turned."""
    decoded = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where(F.col("width") * F.col("height") <= MOST_PIXELS)
    hashes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("origin"), F.sha2("content", 256).alias("sha256"))

    @F.pandas_udf("binary")
    def rgba(data, channels):
        out = []
        for d, n in zip(data, channels, strict=True):
            x = np.frombuffer(d, np.uint8).reshape(-1, n)
            colour = x[:, [2, 1, 0]] if n >= 3 else np.repeat(x[:, :1], 3, 1)
            alpha = x[:, 3:4] if n == 4 else np.full((len(x), 1), 255, np.uint8)
            out.append(np.hstack([colour, alpha]).tobytes())
        import pandas as pd

        return pd.Series(out)

    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return decoded.withColumn("k", same(F.col("origin"))).join(hashes.select(same(F.col("origin")).alias("k"), "sha256"), "k").select(F.col("k").alias("path"), "sha256", "width", "height", rgba("data", "nChannels").alias("rgba"))


def verified(files: DataFrame, manifest: DataFrame, most: int = 10_000_000) -> DataFrame:
    """Files (name, content) as the manifest (name, md5, size) has them; any other name, hash or size is an error."""
    both = manifest.join(files, "name", "full")
    bad = (F.col("md5").isNull()) | (F.col("content").isNull()) | (F.md5("content") != F.col("md5")) | (F.length("content") != F.col("size")) | (F.length("content") > most) | F.col("name").rlike(r"(^/)|(\.\.)")
    assert_none(both.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_files")))
    return files


def mesh_volume(lines: DataFrame) -> DataFrame:
    """volume and bounding box of an ASCII mesh given as value lines with their number n: a sixth of the sum of determinants."""
    number = r"([-+0-9.eE]+)"
    v = lines.where(F.col("value").rlike(r"^\s*vertex\s")).withColumn("k", F.sum(F.lit(1)).over(_order()) - 1)
    pattern = rf"vertex\s+{number}\s+{number}\s+{number}"
    v = v.select(F.floor(F.col("k") / 3).alias("face"), (F.col("k") % 3).alias("c"), *[F.regexp_extract("value", pattern, i + 1).cast("double").alias(a) for i, a in enumerate("xyz")])
    at = lambda a, k: F.max(F.when(F.col("c") == k, F.col(a)))
    faces = v.groupBy("face").agg(*[at(a, k).alias(f"{a}{k}") for a in "xyz" for k in range(3)])
    det = F.expr("x0 * (y1 * z2 - y2 * z1) - y0 * (x1 * z2 - x2 * z1) + z0 * (x1 * y2 - x2 * y1)")
    box = [f(f"{g}({a}0, {a}1, {a}2)").alias(n) for a in "xyz" for g, f, n in (("least", lambda e: F.min(F.expr(e)), f"min_{a}"), ("greatest", lambda e: F.max(F.expr(e)), f"max_{a}"))]
    return faces.agg((F.sum(det) / 6).alias("volume"), *box)


def _order():
    from pyspark.sql import Window

    return Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)


def parse_typed(text: str):
    """JSON whose packed arrays become numpy arrays."""

    def back(x: dict):
        if "$typed" in x:
            if x["$typed"] not in TYPED:
                raise ContractError(f"unknown array type {x['$typed']}")
            return np.frombuffer(base64.b64decode(x["base64"]), TYPED[x["$typed"]])
        return x

    return json.loads(text, object_hook=back)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table's files, be it a folder of them or one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
