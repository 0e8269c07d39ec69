"""Scoring reads against ground truth, and calibrating the gate by a grid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.operators import gate

# Agreement of a correct read, and the grid's allowed shares of bad measures.
GOOD = 0.85
ALLOWED_BAD = (0.0, 0.25, 0.5, 0.75, 1.01)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of MIDI numbers, each a character; null numbers are a value of their own.

    Numbers must lie within -900..60000; characters start above ASCII.
    """

    def text(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda m: F.decode(F.unhex(F.lpad(F.hex(F.coalesce(m, F.lit(-999)) + 2000), 4, "0")), "UTF-16BE")), "")

    return F.levenshtein(text(a), text(b))


def agreement(truth: Column, read: Column) -> Column:
    """1 less the edit distance by the longer length; 1 if both are empty, 0 if one is."""
    longest = F.greatest(F.size(truth), F.size(read))
    return F.when(longest == 0, 1.0).when((F.size(truth) == 0) | (F.size(read) == 0), 0.0).otherwise(1.0 - edit_distance(truth, read) / longest)


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (truth, read arrays) with agreement and should_accept, judged before any rounding."""
    return pairs.withColumn("agreement", agreement(F.col("truth"), F.col("read"))).withColumn("should_accept", F.col("agreement") >= GOOD)


def graded(rows: DataFrame) -> DataFrame:
    """(piece, quality, mean_ctx, bad_frac, should_accept) of the rows of a dataset that can calibrate: read, with grades.

    rows: as sources.files.dataset(). Reads without output, without features or without a mean grade stay out.
    """
    kept = rows.where("audiveris_ok and features is not null and features.mean_ctx is not null")
    return kept.select("piece", "quality", F.col("features.mean_ctx").alias("mean_ctx"), F.col("features.measures_bad_frac").alias("bad_frac"), F.coalesce("should_accept", F.lit(False)).alias("should_accept"))


def features(reads: DataFrame) -> DataFrame:
    """reads (tokens, bad, total, head_count, mean_ctx, min_ctx, weak) with ``features``, the struct that a dataset holds.

    Shares are rounded to 3 digits; what needs grades is null without them.
    """
    counted = gate.leap_counts(gate.midi_array(F.col("tokens")))
    wild = F.when(F.col("_leaps.leaps") > 0, F.col("_leaps.wide") / F.col("_leaps.leaps")).otherwise(0.0)
    has = F.coalesce(F.col("head_count") > 0, F.lit(False))
    total = F.coalesce("total", F.lit(0))
    made = F.struct(
        F.size("tokens").alias("note_count"), gate.rounded(wild).alias("wild_frac"),
        F.when(total > 0, gate.rounded(F.try_divide(F.col("bad"), total))).otherwise(0.0).alias("measures_bad_frac"), total.cast("int").alias("measures_total"),
        F.when(has, F.col("mean_ctx")).alias("mean_ctx"), F.when(has, F.col("min_ctx")).alias("min_ctx"), F.when(has, F.col("head_count").cast("int")).alias("head_count"),
        F.when(has, gate.rounded(F.try_divide(F.col("weak"), F.col("head_count")))).alias("weak_frac"),
    )
    return reads.withColumn("_leaps", counted).withColumn("features", made).drop("_leaps")


def collected(manifest: DataFrame, reads: DataFrame) -> DataFrame:
    """The dataset of a manifest (image, piece, quality, gt_tokens, gt_midi) and reads of its images, one row an image.

    reads: image, tokens (null or no row: no output), what features() needs, and note, the reader's error. Rows are as
    sources.files.dataset() reads them; should_accept is judged before the agreement is rounded.
    """
    made = features(reads).select(F.col("image").alias("of"), "tokens", "features", F.col("note").alias("told"))
    rows = manifest.join(made, F.col("image") == F.col("of"), "left")
    ok, found = F.col("tokens").isNotNull(), agreement(F.col("gt_midi"), gate.midi_array(F.col("tokens")))
    return rows.select(
        "image", "piece", "quality", F.col("gt_tokens").alias("gt"), ok.alias("audiveris_ok"), F.coalesce("tokens", F.array().cast("array<string>")).alias("notes"),
        F.when(ok, gate.rounded(found)).otherwise(0.0).alias("agreement"), F.when(ok, found >= GOOD).otherwise(False).alias("should_accept"),
        F.when(ok, F.col("features")).alias("features"), F.when(~ok, F.substring(F.coalesce("told", F.lit("")), 1, 80)).alias("note"),
    )


def grid(reads: DataFrame) -> DataFrame:
    """(t_idx, t, m_idx, m): thresholds just under each distinct mean_ctx (rounded to 3), 0 and 1.01, by ALLOWED_BAD.

    Distinct values of a number rounded to 3 digits in 0..1 are 1001 at most, so the grid has 5015 rows at most.
    """
    values = reads.select(F.bround("mean_ctx", 3).alias("v")).distinct().agg(F.sort_array(F.collect_set("v")).alias("vs"))
    ts = F.concat(F.array(F.lit(0.0)), F.transform("vs", lambda v: v - 0.001), F.array(F.lit(1.01)))
    ms = F.array(*[F.lit(m) for m in ALLOWED_BAD])
    rows = values.select(F.posexplode(ts).alias("t_idx", "t"))
    return rows.select("t_idx", "t", F.posexplode(ms).alias("m_idx", "m"))


def confusion(reads: DataFrame, points: DataFrame) -> DataFrame:
    """points with tp, fp, fn over reads (mean_ctx, bad_frac, should_accept).

    Reads are first counted by their place among the sorted thresholds and allowed shares (a grid cell each); acceptance
    is then a comparison of places, summed over the cells. No read meets more than its own cell. A point's own place is
    looked up, as t_idx is no place among the sorted thresholds: those under a mean_ctx of 0 or 0.001 lie below or at 0.
    """
    ts = points.agg(F.sort_array(F.collect_set("t")).alias("ts"))
    ms = F.array(*[F.lit(m) for m in ALLOWED_BAD])
    placed = reads.join(F.broadcast(ts)).select(
        F.size(F.filter("ts", lambda t: F.col("mean_ctx") >= t)).alias("over"),
        F.size(F.filter(ms, lambda m: F.col("bad_frac") > m)).alias("past"),
        F.col("should_accept").alias("good"),
    )
    cells = placed.groupBy("over", "past").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("wrong"))
    total = cells.agg(F.sum("good").alias("goods"))
    points = points.join(F.broadcast(ts)).withColumn("place", F.array_position("ts", F.col("t"))).drop("ts")
    joined = points.join(F.broadcast(cells), (F.col("over") >= F.col("place")) & (F.col("past") <= F.col("m_idx")), "left")
    counts = joined.groupBy("t_idx", "t", "m_idx", "m").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("tp"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("fp"))
    return counts.join(F.broadcast(total)).select("t_idx", "t", "m_idx", "m", "tp", "fp", (F.coalesce("goods", F.lit(0)) - F.col("tp")).alias("fn"))


def best(counts: DataFrame) -> DataFrame:
    """The grid point without wrong accepts (if any), then most right ones; the first in grid order wins ties."""
    return counts.orderBy((F.col("fp") == 0).desc(), F.desc("tp"), F.asc("fn"), "t_idx", "m_idx").limit(1)


def calibrated(reads: DataFrame) -> DataFrame:
    """One row of gate parameters; thresholds are held to what the gate's loader takes (0..1 and 0..1.01)."""
    counts = confusion(reads, grid(reads))
    sizes = reads.agg(F.count(F.lit(1)).alias("n"), F.count_if("should_accept").alias("good"))
    row = best(counts).join(F.broadcast(sizes))
    ratio = [F.concat(F.col(a).cast("string"), F.lit("/"), b.cast("string")) for a, b in (("tp", F.col("good")), ("fp", F.col("n") - F.col("good")))]
    return row.select(F.bround(F.least(F.greatest("t", F.lit(0.0)), F.lit(1.0)), 3).alias("ctx_mean_min"), F.col("m").alias("measure_bad_fraction"), F.col("n").alias("calibrated_on"), ratio[0].alias("accepts_correct"), ratio[1].alias("accepts_wrong"))
