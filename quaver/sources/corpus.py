"""The labelled corpus: pieces whose notes are known, by quality levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions.pitch import strict_midi

# Pieces with their sounding notes, and the quality levels they are rendered at.
PIECES = {
    "cmajor": "C4 D4 E4 F4 G4 A4 B4 C5",
    "fmajor": "F4 G4 A4 Bb4 C5 D5 E5 F5",
    "dmajor": "D4 E4 F#4 G4 A4 B4 C#5 D5",
    "triad": "C4 E4 G4 C5 G4 E4 C4",
    "mixed": "C4 D4 E4 F4 G4 A4 B4",
    "pickup": "G4 C5 B4 A4 G4 F4 E4 D4",
    "sustained": "C4 G4 E4",
    "beams_rests": "C4 D4 E4 F4 G4 A4 B4 C5 G4 E4",
}
QUALITIES = ("clean", "blur", "jpeg", "skew", "noise", "lowcontrast", "photo")


def labelled(spark: SparkSession) -> DataFrame:
    """(piece, quality, gt_tokens, gt_midi): each piece at each quality."""
    rows = spark.createDataFrame(list(PIECES.items()), "piece string, notes string")
    rows = rows.select("piece", F.explode(F.array(*[F.lit(q) for q in QUALITIES])).alias("quality"), F.split("notes", " ").alias("gt_tokens"))
    return rows.withColumn("gt_midi", F.transform("gt_tokens", strict_midi))
