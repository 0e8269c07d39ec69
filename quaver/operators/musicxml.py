"""Reading MusicXML: tokens, key, and whether measures add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import pitch as P

_ATTRIBUTES = "array<struct<divisions:string,key:array<struct<fifths:string>>,time:array<struct<beats:string,`beat-type`:string>>>>"
_NOTES = "array<struct<pitch:struct<step:string,alter:string,octave:string>,rest:string,chord:string,duration:string>>"
_MEASURES = f"array<struct<attributes:{_ATTRIBUTES},note:{_NOTES}>>"
_PARTS = f"array<struct<measure:{_MEASURES}>>"
SCHEMA = f"part {_PARTS}"


def parsed(reads: DataFrame) -> DataFrame:
    """reads (read_id, musicxml) with ``part``, null where the text is no MusicXML. Leaves are strings."""
    return reads.select("read_id", F.from_xml("musicxml", SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("x")).select("read_id", "x.part")


def _measures(reads: DataFrame) -> DataFrame:
    rows = parsed(reads).select("read_id", F.posexplode("part").alias("p", "one"))
    return rows.select("read_id", "p", F.posexplode("one.measure").alias("m", "measure"))


def tokens(reads: DataFrame) -> DataFrame:
    """(read_id, seq from 0, token) in document order: rests, chord members and unpitched or ill-formed notes go.

    The step must be one letter; an alteration that is no number is 0, others are cut toward zero.
    """
    notes = F.flatten(F.transform(_filled(F.col("part"), _PARTS), lambda p: F.flatten(F.transform(_filled(p["measure"], _MEASURES), lambda m: _filled(m["note"], _NOTES)))))

    def parts(note):
        step, octave = F.upper(P.trimmed(note["pitch"]["step"])), P.trimmed(note["pitch"]["octave"])
        alter = F.coalesce(P.trimmed(note["pitch"]["alter"]).try_cast("double"), F.lit(0.0)).try_cast("int")
        sounds = note["rest"].isNull() & note["chord"].isNull() & note["pitch"].isNotNull() & step.rlike("^[A-G]$") & octave.rlike("^-*[0-9]+$")
        return F.when(sounds, F.concat(step, P.alter_suffix(alter), octave))

    return parsed(reads).select("read_id", F.posexplode(F.array_compact(F.transform(notes, parts))).alias("seq", "token"))


def _filled(array, kind: str):
    return F.coalesce(array, F.array().cast(kind))


def key_fifths(reads: DataFrame) -> DataFrame:
    """(read_id, key_fifths): the first key of the document, null if there is none or it is no number."""
    keys = F.flatten(F.flatten(F.flatten(F.transform("part", lambda p: F.transform(p["measure"], lambda m: F.transform(_filled(m["attributes"], _ATTRIBUTES), lambda a: F.coalesce(a["key"], F.array().cast("array<struct<fifths:string>>"))))))))
    first = P.trimmed(F.get(F.filter(keys, lambda k: k["fifths"].isNotNull()), F.lit(0))["fifths"])
    return parsed(reads).select("read_id", F.when(first.rlike("^-*[0-9]+$"), first.try_cast("int")).alias("key_fifths"))


def measure_rows(reads: DataFrame) -> DataFrame:
    """(read_id, part, measure, divisions, beats, beat_type, duration): what each measure declares and its notes sum to.

    Rests count, chord members do not; values that are no digits count as not declared.
    """

    def digits(c):
        return F.when(P.trimmed(c).rlike("^[0-9]+$"), P.trimmed(c).try_cast("int"))

    a = F.col("measure.attributes")
    first = F.get(F.filter(F.transform(a, lambda x: x["divisions"]), lambda d: d.isNotNull()), F.lit(0))
    time = F.get(F.flatten(F.transform(a, lambda x: F.coalesce(x["time"], F.array().cast("array<struct<beats:string,`beat-type`:string>>")))), F.lit(0))
    length = F.aggregate(
        _filled(F.col("measure.note"), _NOTES),
        F.lit(0),
        lambda s, n: s + F.when(n["chord"].isNull() & P.trimmed(n["duration"]).rlike("^-*[0-9]+$"), F.coalesce(P.trimmed(n["duration"]).try_cast("int"), F.lit(0))).otherwise(0),
    )
    return _measures(reads).select(
        "read_id", F.col("p").alias("part"), F.col("m").alias("measure"), digits(first).alias("divisions"),
        digits(time["beats"]).alias("beats"), digits(time["beat-type"]).alias("beat_type"), length.alias("duration"),
    )


def coherence(measures: DataFrame) -> DataFrame:
    """(read_id, bad, total) of measure_rows(): how many measures can be checked, and how many do not add up.

    Divisions and meter carry on from measure to measure, over parts as well; a measure without all three (or with one
    that is 0) is not checked. It is bad if it is off by more than one tick and a tenth of what is due.
    """
    order = W.partitionBy("read_id").orderBy("part", "measure").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = measures.select("read_id", "duration", *[F.last(c, ignorenulls=True).over(order).alias(c) for c in ("divisions", "beats", "beat_type")])
    due = F.col("divisions") * F.col("beats") * 4 / F.col("beat_type")
    checked = carried.where("divisions > 0 and beats > 0 and beat_type > 0")
    off = F.abs(F.col("duration") - due) > F.greatest(F.lit(1.0), 0.1 * due)
    return checked.groupBy("read_id").agg(F.count_if(off).alias("bad"), F.count(F.lit(1)).alias("total"))
