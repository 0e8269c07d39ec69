"""The confidence gate: five checks of a read, in order, with a recorded decision path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import pitch as P

# Limits of the checks, and hand-set thresholds used where no calibrated ones are given.
MIN_NOTES, WIDE_LEAP, WIDE_SHARE = 2, 24, 0.5
WEAK_HEAD, WEAK_SHARE = 0.35, 0.5
CTX_MEAN_MIN, MEASURE_BAD_FRACTION = 0.55, 0.5


def leaps(notes: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, seq, leap): absolute difference to the note before, of notes (key, seq, midi); null midi are left out first."""
    order = W.partitionBy(key).orderBy("seq")
    rows = notes.where("midi is not null").select(key, "seq", F.abs(F.col("midi") - F.lag("midi").over(order)).alias("leap"))
    return rows.where("leap is not null")


def midi_array(tokens: Column) -> Column:
    return F.transform(tokens, P.strict_midi)


def leap_counts(midis: Column) -> Column:
    """struct<leaps, wide> of an array of MIDI numbers, nulls left out: no shuffle where a read is a row."""
    def counted(valid: Column) -> Column:
        steps = F.transform(F.slice(valid, 2, F.greatest(F.size(valid) - 1, F.lit(0))), lambda x, i: F.abs(x - F.get(valid, i)))
        return F.struct(F.size(steps).alias("leaps"), F.size(F.filter(steps, lambda d: d > WIDE_LEAP)).alias("wide"))

    # Bound once as the one element of an array: inlined, the notes would be made anew for each step.
    return F.get(F.transform(F.array(F.array_compact(midis)), counted), F.lit(0))


def grade_summary(heads: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, head_count, mean and min of grade and ctx) of heads (key, grade, ctx?); ctx is the grade where missing.

    Means are not rounded; see rounded().
    """
    ctx = F.coalesce("ctx", "grade")
    return heads.groupBy(key).agg(
        F.count(F.lit(1)).alias("head_count"), F.avg("grade").alias("mean_grade"), F.min("grade").alias("min_grade"),
        F.avg(ctx).alias("mean_ctx"), F.min(ctx).alias("min_ctx"), F.count_if(ctx < WEAK_HEAD).alias("weak"),
    )


def rounded(value: Column, digits: int = 3) -> Column:
    """Rounded half to even on the shortest decimal form."""
    return F.bround(value, digits)


def thresholds(candidates: DataFrame) -> DataFrame:
    """One row (ctx_mean_min, measure_bad_fraction, source): the valid candidate of smallest priority, else hand-set.

    candidates: priority, path, ctx_mean_min, measure_bad_fraction as text. Valid are numbers with the first in 0..1 and
    the second in 0..1.01.
    """
    ctx, bad = (F.col(c).try_cast("double") for c in ("ctx_mean_min", "measure_bad_fraction"))
    valid = candidates.select("priority", "path", ctx.alias("ctx"), bad.alias("bad")).where("ctx between 0 and 1 and bad between 0 and 1.01")
    best = valid.agg(F.min_by(F.struct("ctx", "bad", "path"), "priority").alias("b"))
    return best.select(
        F.coalesce("b.ctx", F.lit(CTX_MEAN_MIN)).alias("ctx_mean_min"), F.coalesce("b.bad", F.lit(MEASURE_BAD_FRACTION)).alias("measure_bad_fraction"),
        F.coalesce(F.concat(F.lit("calibrated ("), "b.path", F.lit(")")), F.lit("fallback (hand-set guesses)")).alias("source"),
    )


def _percent(share: Column) -> Column:
    return F.concat(F.bround(100 * share, 0).cast("int").cast("string"), F.lit("%"))


def _plain(number: Column) -> Column:
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def assessed(reads: DataFrame, ctx_mean_min: Column | None = None, measure_bad_fraction: Column | None = None, engine: str = "engine") -> DataFrame:
    """reads with ok, reason, decision_path (array of check, ok, detail, source in fixed order).

    reads: tokens (array), bad, total (of coherence(); null counts 0), head_count, mean_ctx, min_ctx, weak (of
    grade_summary(), null without grades). One row a read, no shuffle. Tokens with double accidentals have no MIDI number
    and fail pitch_range; an empty read fails it too.
    """
    least = F.lit(CTX_MEAN_MIN) if ctx_mean_min is None else ctx_mean_min
    most = F.lit(MEASURE_BAD_FRACTION) if measure_bad_fraction is None else measure_bad_fraction
    n = F.size("tokens")
    midis = midi_array(F.col("tokens"))
    within = (n > 0) & F.forall(midis, lambda m: F.coalesce(m.between(P.PIANO_LOW, P.PIANO_HIGH), F.lit(False)))
    counted = leap_counts(midis)
    rows = reads.withColumns({"_n": n, "_within": within, "_leaps": counted, "_bad": F.coalesce("bad", F.lit(0)), "_total": F.coalesce("total", F.lit(0))})
    wide = F.when(F.col("_leaps.leaps") > 0, F.col("_leaps.wide") / F.col("_leaps.leaps")).otherwise(0.0)
    weak = F.col("weak") / F.col("head_count")
    graded = F.coalesce(F.col("head_count") > 0, F.lit(False))
    sums = ~((F.col("_total") >= 2) & (F.coalesce(F.try_divide(F.col("_bad"), F.col("_total")), F.lit(0.0)) > most))
    graded_detail = F.concat(
        F.lit("mean ctx-grade "), F.format_number("mean_ctx", 2), F.lit(" (min "), F.format_number("min_ctx", 2), F.lit("), "),
        _percent(weak), F.lit(f" below {WEAK_HEAD}; need mean ≥"), _plain(least),
    )

    def check(name: str, ok: Column, detail: Column, source: str) -> Column:
        return F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.alias("detail"), F.lit(source).alias("source"))

    path = F.array(
        check("note_count", F.col("_n") >= MIN_NOTES, F.concat(F.col("_n").cast("string"), F.lit(" note(s)")), "tokens"),
        check("pitch_range", F.col("_within"), F.when(F.col("_within"), "all within A0–C8").otherwise("a note is out of range"), "tokens"),
        check("erratic_leaps", wide < WIDE_SHARE, F.concat(_percent(wide), F.lit(" of steps leap >2 octaves")), "tokens"),
        check("measure_arithmetic", sums, F.concat(F.col("_bad").cast("string"), F.lit("/"), F.col("_total").cast("string"), F.lit(" measures don't add up (allowed ≤"), _plain(most), F.lit(")")), "musicxml"),
        check(f"{engine}_grades", ~graded | ((F.col("mean_ctx") >= least) & (weak <= WEAK_SHARE)), F.when(graded, graded_detail).otherwise("no grade data available"), engine),
    )
    rows = rows.withColumn("decision_path", path).drop("_n", "_within", "_leaps", "_bad", "_total")
    failed = F.filter("decision_path", lambda c: ~c["ok"])
    told = F.transform(failed, lambda c: F.concat(c["check"], F.lit(" ["), c["source"], F.lit("]: "), c["detail"]))
    return rows.withColumns({"ok": F.size(failed) == 0, "reason": F.array_join(told, "; ")})


def read_results(assessed_reads: DataFrame) -> DataFrame:
    """What an engine read gives: success, notes (empty unless accepted), confidence, error; a rejected read keeps its XML."""
    accepted = F.col("ok") & (F.size("tokens") > 0)
    error = F.when(accepted, "").when(F.col("reason") != "", F.concat(F.lit("Read rejected (low confidence): "), "reason")).otherwise("The engine ran but found no pitched notes")
    confidence = F.when(F.col("head_count") > 0, F.col("mean_ctx"))
    return assessed_reads.withColumns({"success": accepted, "notes": F.when(accepted, F.col("tokens")).otherwise(F.array().cast("array<string>")), "confidence": confidence, "error": error})


def path_rows(assessed_reads: DataFrame) -> DataFrame:
    """(read_id, ord, check, ok, detail, source), one row a check."""
    return assessed_reads.select("read_id", F.posexplode("decision_path").alias("ord", "c")).select("read_id", "ord", "c.*")
