"""Live meters: each value as a share of the best so far, which a changed setting resets; by windows in a batch, by state on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def metered(rows: DataFrame) -> DataFrame:
    """session, at, tie, setting, value, best, share, run of rows (session, at, tie, setting, value), in order of at and tie. best is the largest
    value since the setting last changed; a null value changes nothing and has no share, nor has one under a best of 0."""
    w = Window.partitionBy("session").orderBy("at", "tie")
    changed = F.coalesce((~F.col("setting").eqNullSafe(F.lag("setting").over(w))).cast("int"), F.lit(0))
    first = F.row_number().over(w) == 1
    runs = rows.select("session", "at", "tie", "setting", "value").withColumn("run", F.sum(F.when(first, 0).otherwise(changed)).over(w).cast("int"))
    best = F.max("value").over(Window.partitionBy("session", "run").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("best", best).withColumn("share", F.col("value") / F.when(F.col("best") != 0, F.col("best")))


def stream_metered(stream: DataFrame) -> DataFrame:
    """The same rows of a stream whose batches come in order: a session's best, setting and run are its state, so a batch reads no row of
    the batches before it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select("session", "at", "tie", "setting", "value").schema)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.exists
        best, setting, number = state.get if known else (None, None, 0)
        # The rows of one session in one batch; its rows of other batches are only in the state.
        for pdf in [pd.concat(list(parts)).sort_values(["at", "tie"])]:
            out = []
            for value, now in zip(pdf["value"], pdf["setting"], strict=True):
                now = None if pd.isna(now) else now
                if known and now != setting:
                    best, number = None, number + 1
                known, setting = True, now
                if not pd.isna(value):
                    best = value if best is None else max(best, value)
                out.append((best, None if pd.isna(value) or not best else value / best, number))
            b, share, runs = zip(*out, strict=True)
            state.update((None if best is None else float(best), setting, number))
            yield pdf[["session", "at", "tie", "setting", "value"]].assign(best=pd.array(b, "Float64"), share=pd.array(share, "Float64"), run=list(runs))

    own = stream.select("session", "at", "tie", "setting", "value")
    return own.groupBy("session").applyInPandasWithState(run, f"{schema}, best double, share double, run int", f"best double, setting {kinds['setting']}, run int", "append", GroupStateTimeout.NoTimeout)
