"""Batch steps around the records: parsing names and id lists, run lengths, landmark coordinates, schedules of views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The pattern of a specimen's file name, and of what follows the specimen in it.
FILE_NAME = r"^(cryptarum|lucorum|terrestris)-([FM])-.+\.dw\.png$"
SIDE = r"-[LR]\.dw\.png$"


def from_file_name(file: Column) -> tuple[Column, Column, Column]:
    """species, sex and specimen that a file name states; null where it doesn't follow the pattern."""
    fits = file.rlike(FILE_NAME)
    return F.when(fits, F.regexp_extract(file, FILE_NAME, 1)), F.when(fits, F.regexp_extract(file, FILE_NAME, 2)), F.when(fits, F.regexp_replace(file, SIDE, ""))


def id_list(lines: DataFrame) -> DataFrame:
    """id of each line: its first comma-separated field, without blanks and header words (root, id, cell ...)."""
    own = F.trim(F.split_part(F.col("value"), F.lit(","), F.lit(1)))
    return lines.select(own.alias("id")).where((F.col("id") != "") & ~F.lower("id").rlike("^(root|id|cell)")).distinct()


def run_lengths(cells: DataFrame, key: str, position: str, bit: str) -> DataFrame:
    """key, run, bit, length: runs of equal bits by position; the first run counts zeros and may be empty."""
    w = Window.partitionBy(key).orderBy(position)
    starts = cells.withColumn("_new", (F.col(bit) != F.lag(bit, 1, 0).over(w)).cast("int"))
    runs = starts.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    counted = runs.groupBy(key, "run").agg(F.max(bit).alias("bit"), F.count("*").alias("length"))
    first = counted.groupBy(key).agg(F.min("run").alias("run")).where("run = 1").select(key, F.lit(0).alias("run"), F.lit(0).alias("bit"), F.lit(0).cast("long").alias("length"))
    return counted.select(key, "run", F.col("bit").cast("int").alias("bit"), "length").unionByName(first)


def canonical_landmarks(points: Column, base: int = 0, tip: int = 1, upper: int = 6, lower: int = 12) -> Column:
    """Points x, y (y up) turned so that the base is left of the tip and landmark 7 above 13: of the four flips the first that fits."""
    down = F.transform(points, lambda p: F.struct(p["x"].alias("x"), (-p["y"]).alias("y")))
    flips = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1.0, 1.0), (-1.0, -1.0), (-1.0, 1.0), (1.0, -1.0))])
    made = F.transform(flips, lambda s: F.transform(down, lambda p: F.struct((p["x"] * s["a"]).alias("x"), (p["y"] * s["b"]).alias("y"))))
    fits = lambda v: (F.get(v, F.lit(base))["x"] < F.get(v, F.lit(tip))["x"]) & (F.get(v, F.lit(upper))["y"] < F.get(v, F.lit(lower))["y"])
    return F.get(F.filter(made, fits), F.lit(0))


def landmark_lines(rows: DataFrame, points: str, file: str, width: int, height: Column | None = None) -> DataFrame:
    """value: CSV lines, quotes doubled, two decimals, a missing point empty; with a height y is turned to run upwards."""
    y = lambda p: (height - 1 - p["y"]) if height is not None else p["y"]
    cell = lambda p: F.when(p.isNull(), F.lit(",")).otherwise(F.concat(F.format_string("%.2f", p["x"]), F.lit(","), F.format_string("%.2f", y(p))))
    every = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: cell(F.get(F.col(points), i)))
    name = F.concat(F.lit('"'), F.replace(F.col(file), F.lit('"'), F.lit('""')), F.lit('"'))
    return rows.select(F.concat_ws(",", name, F.array_join(every, ",")).alias("value"))


def landmark_state(points: Column) -> tuple[Column, Column, Column]:
    """placed (count), complete and first open index of points whose struct has state 'placed', 'missing' or 'open'."""
    placed = F.size(F.filter(points, lambda p: p["state"] == "placed"))
    first = F.array_position(F.transform(points, lambda p: p["state"]), "open") - 1
    return placed, placed == F.size(points), F.when(first >= 0, first)


def mapped(points: Column, matrix: Column) -> Column:
    """Points x, y through an affine matrix of nine numbers by rows; a point that is null or has no coordinates stays null."""
    m = [F.get(matrix, F.lit(i)) for i in range(6)]
    at = lambda p: F.struct((m[0] * p["x"] + m[1] * p["y"] + m[2]).alias("x"), (m[3] * p["x"] + m[4] * p["y"] + m[5]).alias("y"))
    return F.transform(points, lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), at(p)))


def inverse(matrix: Column) -> Column:
    """The inverse of an affine matrix of nine numbers; an error if it has none."""
    a, b, c, d, e, f = (F.get(matrix, F.lit(i)) for i in range(6))
    det = a * e - b * d
    made = F.array(e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return F.when(F.abs(det) < 1e-12, F.raise_error(F.lit("the matrix has no inverse"))).when(det.isNotNull(), made)


def from_upward(points: Column, height: Column) -> Column:
    """Points of a table whose y runs up, in an image whose y runs down."""
    return F.transform(points, lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), F.struct(p["x"].alias("x"), (height - 1 - p["y"]).alias("y"))))


def landmark_block(points: Column, matrix: Column, confirmed: Column) -> Column:
    """x, y, x, y, ... on the canvas, if no point is missing and the view is confirmed, else null: mirror images never mix."""
    on = mapped(points, matrix)
    whole = (F.size(points) > 0) & F.forall(on, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(F.coalesce(confirmed, F.lit(False)) & F.coalesce(whole, F.lit(False)), F.flatten(F.transform(on, lambda p: F.array(p["x"], p["y"]))))


def first_middle_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each group the first, middle and last row."""
    w = Window.partitionBy(*keys)
    at, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    return rows.withColumn("_at", at).withColumn("_n", n).where((F.col("_at") == 1) | (F.col("_at") == F.floor(F.col("_n") / 2) + 1) | (F.col("_at") == F.col("_n"))).drop("_at", "_n")


def width_profile(rows: DataFrame, key: str, along: str, across: str, bins: int = 40) -> DataFrame:
    """key, bin, width: the extent across in equal bins along; the last bin is closed."""
    ends = rows.groupBy(key).agg(F.min(along).alias("_a"), F.max(along).alias("_b"))
    share = F.try_divide(F.col(along) - F.col("_a"), F.col("_b") - F.col("_a"))
    binned = rows.join(ends, key).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)).cast("int"))
    return binned.groupBy(key, "bin").agg((F.max(across) - F.min(across)).alias("width"))


def accepted(processed: Column, confirmed: Column, needs_review: Column, reason: Column, paired: Column) -> Column:
    """Quality gate: processed and confirmed, reviewed with a reason if need be, and its pair confirmed."""
    return processed & confirmed & (~needs_review | (F.length(F.trim(F.coalesce(reason, F.lit("")))) > 0)) & paired


def with_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """rows with the profile of their modality and size, or a note why there is none."""
    known = profiles.select("modality").distinct().withColumn("_known", F.lit(True))
    out = rows.join(profiles, ["modality", "width", "height"], "left").join(known, "modality", "left")
    note = F.when(F.col("profile_id").isNotNull(), F.lit(None)).when(F.col("_known"), F.lit("size differs")).otherwise(F.lit("no profile"))
    return out.withColumn("note", note.cast("string")).drop("_known")
