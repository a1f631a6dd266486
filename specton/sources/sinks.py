"""Sinks: reference envelopes, graph files, landmark CSV, reports, and tables keyed by id."""

from __future__ import annotations

import base64
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specton.operators.references import upsert
from specton.sources.files import TYPED


def write_references(rows: DataFrame, path: str, version: str) -> None:
    """One JSON record a line, each with the version it was written under."""
    rows.select(F.lit(version).alias("version"), F.struct(*rows.columns).alias("reference")).write.json(path)


def graph_document(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row, json: a graph of bounded size (its preparation caps nodes and edges) in one document."""
    ids = nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda s: s["id"]).alias("nodes"))
    rows = edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "w"))), lambda s: F.array(s["src"].cast("double"), s["dst"].cast("double"), s["w"])).alias("edges"))
    return ids.join(F.broadcast(rows)).select(F.to_json(F.struct(F.lit(name).alias("format"), "nodes", "edges")).alias("json"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def write_report(report: DataFrame, path: str, inputs: dict[str, str]) -> None:
    """A report with the SHA-256 of its inputs; an existing path is an error, so no input is overwritten."""
    report.select(*report.columns, *[F.lit(h).alias(f"sha256_{n}") for n, h in sorted(inputs.items())]).write.mode("errorifexists").json(path)


def save_rows(incoming: DataFrame, path: str, key: str = "id") -> str:
    """Upsert into a Parquet table: the new state goes to a sibling path, which is returned, and readers move over."""
    spark = incoming.sparkSession
    target = f"{path.rstrip('/')}-next"
    upsert(spark.read.parquet(path), incoming, key).write.parquet(target)
    return target


def delete_rows(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def dump_typed(value) -> str:
    """JSON with numpy arrays packed: the reverse of ``parse_typed``."""
    names = {np.dtype(v): k for k, v in reversed(TYPED.items())}

    def pack(x):
        if isinstance(x, np.ndarray):
            return {"$typed": names[x.dtype], "base64": base64.b64encode(x.tobytes()).decode()}
        raise TypeError(type(x))

    return json.dumps(value, default=pack)


def run_length_text(runs: DataFrame, key: str) -> DataFrame:
    """key, rle: the lengths of a mask's runs in order, zeros first."""
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "length"))), lambda s: s["length"].cast("string")), " ").alias("rle"))
