"""Signal operators over exploded rasters and marks: histograms, islands, rolling openings, medians, suppression tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Gap within an island, barline span and width, shares of the strongest row and column, mark limits.
ISLAND_GAP = 2
BARLINE_SPAN, BARLINE_WIDTH = 0.82, 0.45
ROW_SHARE, COLUMN_SHARE = 0.35, 0.25
HIGH_STEP, LONELY_SPACES, LONELY_STEPS = 10, 3.0, 4
LOG_FILL, SCAN_FILL, ACCEPT = 0.30, 0.22, 0.58
FILL_RANGE, CORE_MIN = (0.42, 0.95), 0.85
WIDEST, NARROWEST, LOWEST = 2.6, 0.55, 0.60
SCAN_STEPS = (-5, 13)


def histogram(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, level, n): dense 256 levels of each image of pixels (key, v in 0..255)."""
    counts = pixels.groupBy(key, F.col("v").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = pixels.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(255))).alias("level"))
    return levels.join(counts, [key, "level"], "left").select(key, "level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def otsu(histograms: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, threshold): the first level with the largest variance between classes; a class without pixels gives -1."""
    upto = W.partitionBy(key).orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(key)
    d = histograms.select(
        key, "level", F.sum("n").over(upto).cast("double").alias("wb"), F.sum("n").over(whole).cast("double").alias("w"),
        F.sum(F.col("level") * F.col("n")).over(upto).cast("double").alias("sb"), F.sum(F.col("level") * F.col("n")).over(whole).cast("double").alias("s"),
    )
    wf = F.col("w") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    between = F.when((F.col("wb") == 0) | (wf == 0), -1.0).otherwise(F.col("wb") * wf * gap * gap)
    return d.select(key, "level", between.alias("between")).groupBy(key).agg(F.min_by("level", F.struct(-F.col("between"), "level")).alias("threshold"))


def islands(values: DataFrame, key: str = "grp", value: str = "v", gap: int = ISLAND_GAP) -> DataFrame:
    """(key, island, first, last, n, centre): runs of sorted distinct integers whose neighbours differ by at most gap."""
    order = W.partitionBy(key).orderBy(value)
    starts = values.select(key, value).distinct().withColumn("new", (F.col(value) - F.lag(value).over(order) > gap).cast("int"))
    numbered = starts.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))
    return numbered.groupBy(key, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("centre"))


def barlines(columns: DataFrame, staves: DataFrame) -> DataFrame:
    """(staff, x): islands of columns (staff, x, share of ink) that span the staff, are thin and lie inside it.

    staves: staff, spacing, x_start, x_end.
    """
    found = islands(columns.where(F.col("share") >= BARLINE_SPAN), "staff", "x")
    rows = found.join(staves, "staff").withColumn("at", (F.col("first") + F.col("last")) / 2)
    widest = F.greatest(F.lit(1), F.bround(BARLINE_WIDTH * F.col("spacing"), 0))
    return rows.where((F.col("last") - F.col("first") + 1 <= widest) & F.col("at").between(F.col("x_start"), F.col("x_end"))).select("staff", F.col("at").alias("x"))


def content_start(columns: DataFrame, key: str = "staff", intra: int = 3, tail: int = 1) -> DataFrame:
    """(key, x): where notes begin, of inked columns (key, x): the first one after a gap of more than intra blanks.

    Without such a gap it is ``tail`` past the last inked column.
    """
    order = W.partitionBy(key).orderBy("x")
    rows = columns.select(key, "x").distinct().withColumn("blank", F.col("x") - F.lag("x").over(order) - 1)
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("blank") > intra, F.col("x"))), F.max("x") + tail).alias("x"))


def opened(pixels: DataFrame, length: int) -> DataFrame:
    """pixels (row, x from 0 without gaps, ink 0/1) with open: whether the pixel is in a run of ink of ``length`` or more.

    A rolling sum finds the windows that are all ink, a rolling maximum spreads them over their pixels.
    """
    ahead = W.partitionBy("row").orderBy("x").rowsBetween(0, length - 1)
    back = W.partitionBy("row").orderBy("x").rowsBetween(-(length - 1), 0)
    start = (F.sum("ink").over(ahead) == length).cast("int")
    return pixels.withColumn("_start", start).withColumn("open", F.max("_start").over(back)).drop("_start")


def gap_median(centres: DataFrame, key: str = "grp", value: str = "centre") -> DataFrame:
    """(key, spacing): median of the gaps of 2 or more between neighbours, over those up to 1.8 times their median."""
    order = W.partitionBy(key).orderBy(value)
    gaps = centres.select(key, (F.col(value) - F.lag(value).over(order)).alias("gap")).where("gap >= 2")
    base = gaps.groupBy(key).agg(F.median("gap").alias("base"))
    near = gaps.join(base, key).where("gap <= base * 1.8")
    return near.groupBy(key).agg(F.median("gap").alias("spacing"))


def lag_correlation(series: DataFrame, key: str, lags: tuple[int, int]) -> DataFrame:
    """(key, lag, total): sum of products of the values of series (key, at, v) that lie ``lag`` apart, lags[0] to lags[1] - 1."""
    shifted = series.select(key, "v", F.explode(F.sequence(F.lit(lags[0]), F.lit(lags[1] - 1))).alias("lag"), "at")
    other = series.select(key, F.col("at").alias("to"), F.col("v").alias("w"))
    pairs = shifted.withColumn("to", F.col("at") + F.col("lag")).join(other, [key, "to"])
    return pairs.groupBy(key, "lag").agg(F.sum(F.col("v") * F.col("w")).alias("total"))


def tempo_filtered(marks: DataFrame, spacing: float = 1.0) -> DataFrame:
    """marks (id, staff, x, step) without high ones that no other mark of the staff is near, in x and step.

    A semi-join by staff; high marks are few, so they are the side that looks for company.
    """
    high = marks.where(F.col("step") >= HIGH_STEP)
    other = marks.select(F.col("id").alias("o_id"), F.col("staff").alias("o_staff"), F.col("x").alias("o_x"), F.col("step").alias("o_step"))
    near = (F.col("staff") == F.col("o_staff")) & (F.col("id") != F.col("o_id"))
    near = near & (F.abs(F.col("x") - F.col("o_x")) <= LONELY_SPACES * spacing) & (F.abs(F.col("step") - F.col("o_step")) <= LONELY_STEPS)
    return marks.where(F.col("step") < HIGH_STEP).unionByName(high.join(other, near, "left_semi"))


def candidate_grid(staves: DataFrame) -> DataFrame:
    """(staff, step, x, y): where noteheads are looked for, of staves (staff, bottom, spacing, left, right, stride)."""
    steps = staves.withColumn("step", F.explode(F.sequence(F.lit(SCAN_STEPS[0]), F.lit(SCAN_STEPS[1]))))
    rows = steps.where("left <= right").withColumn("x", F.explode(F.sequence("left", "right", "stride")))
    return rows.select("staff", "step", "x", (F.col("bottom") - F.col("step") * (F.col("spacing") / 2)).alias("y"))


def not_solid(core, wide, tall, fill) -> list[tuple]:
    """(reason, whether it holds) in order, why a mark is no solid notehead. Takes columns as well as arrays of numbers."""
    return [
        ("wide bar/beam", wide > WIDEST),
        ("thin stroke (stem/accidental)", wide < NARROWEST),
        ("thin bar (beam)", tall < LOWEST),
        ("weak/ambiguous fill (not a solid head)", (core < CORE_MIN) | (fill < FILL_RANGE[0]) | (fill > FILL_RANGE[1])),
    ]


def notehead_scores(marks: DataFrame) -> DataFrame:
    """marks (fill, core, wide, tall in spacings, stem) with score, kind, reason and whether they are logged as rejected."""
    reason = F.lit("")
    for name, found in reversed(not_solid(F.col("core"), F.col("wide"), F.col("tall"), F.col("fill"))):
        reason = F.when(found, name).otherwise(reason)
    score = F.when(reason != "", 0.0).when(F.col("stem"), 0.85).otherwise(0.70)
    rows = marks.withColumns({"reason": reason, "score": score, "kind": F.when(reason == "", "solid").otherwise("")})
    return rows.withColumns({"accepted": F.col("score") >= ACCEPT, "logged": (F.col("score") < ACCEPT) & (F.col("fill") >= LOG_FILL)})


def suppressed(marks: DataFrame, dx: float, dy: float) -> DataFrame:
    """marks (staff, id, x, y, fill) that survive greedy suppression: strongest first, ties by id, none near a stronger one.

    Greedy choice depends on order, so it is a fold over the sorted marks of one staff.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("fill")).alias("k"), "id", "x", "y", "fill")))
    rows = marks.groupBy("staff").agg(sorted_.alias("all"))
    empty = F.slice("all", 1, 0)

    def step(kept, m):
        near = F.exists(kept, lambda k: (F.abs(k["x"] - m["x"]) < dx) & (F.abs(k["y"] - m["y"]) < dy))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(m)))

    return rows.select("staff", F.explode(F.aggregate("all", empty, step)).alias("m")).select("staff", "m.id", "m.x", "m.y", "m.fill")
