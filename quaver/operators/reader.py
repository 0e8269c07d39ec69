"""Choosing among the readers of an upload: engine, heuristic detector, plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.functions import pitch as P


def chosen(uploads: DataFrame) -> DataFrame:
    """(upload_id, notes, detection_mode, fallback) of uploads (upload_id, engine_notes, heuristic_notes, staff_count, raw_text).

    The engine's notes come first, then the detector's; tokens of the text only where no staff was seen. Null arrays are
    empty. Detectors that cost much should be run on unread() alone.
    """
    text = P.normal_tokens(F.coalesce("raw_text", F.lit("")))
    some = [F.coalesce(F.size(F.col(c)) > 0, F.lit(False)) for c in ("engine_notes", "heuristic_notes")]
    by_text = (F.coalesce("staff_count", F.lit(0)) == 0) & (F.size(text) > 0)
    mode = F.when(some[0], "engine-omr").when(some[1], "heuristic-detection").when(by_text, "text-ocr-fallback").otherwise("none")
    notes = F.when(some[0], F.col("engine_notes")).when(some[1], F.col("heuristic_notes")).when(by_text, text).otherwise(F.array().cast("array<string>"))
    return uploads.select("upload_id", notes.alias("notes"), mode.alias("detection_mode"), mode.isin("heuristic-detection", "text-ocr-fallback").alias("fallback"))


def unread(uploads: DataFrame, reads: DataFrame) -> DataFrame:
    """uploads that no read (upload_id, notes) with notes covers."""
    return uploads.join(reads.where(F.size("notes") > 0), "upload_id", "left_anti")
