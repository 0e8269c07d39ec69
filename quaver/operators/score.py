"""Scores: from token text over arranged notes and measures to MusicXML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions import pitch as P

BEATS, BEAT_TYPE, DIVISIONS, KEY_FIFTHS = 4, 4, 1, -1
SOFTWARE, TITLE = "quaver", "Untitled"


def requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Score requests from JSON text: notes, from_clef, to_clef, title with their defaults, and an error column.

    Text that is no JSON object, and unknown clefs, are told in ``error``; such rows go no further with values.
    """
    schema = "struct<notes:string,from_clef:string,to_clef:string,title:string>"
    parsed = F.from_json(body, schema)

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(P.trimmed(F.col(f"j.{name}")), F.lit("")), F.lit(default))

    rows = bodies.withColumn("j", parsed)
    rows = rows.withColumns({"notes_text": F.coalesce(P.trimmed(F.col("j.notes")), F.lit("")), "from_clef": field("from_clef", "treble"), "to_clef": field("to_clef", "bass"), "title": field("title", TITLE)})
    broken = F.col("j").isNull() | ~P.trimmed(F.col(body)).rlike(r"(?s)^\{.*\}$")
    error = F.when(broken, "Expected JSON body").when(~P.known_clef(F.col("from_clef")) | ~P.known_clef(F.col("to_clef")), "Unknown clef")
    return rows.withColumn("error", error).drop("j")


def notes(scores: DataFrame) -> DataFrame:
    """(score_id, seq from 0, step, alter, octave, midi) of scores (score_id, notes_text), one row a token."""
    rows = scores.select("score_id", F.posexplode(P.tokens_in(F.col("notes_text"))).alias("seq", "written"))
    rows = rows.withColumn("n", P.token_parts(F.col("written")))
    return rows.select("score_id", "seq", "n.step", "n.alter", "n.octave", P.midi(F.col("n.step"), F.col("n.alter"), F.col("n.octave")).alias("midi"))


def score_tokens(text: Column, to_clef: Column) -> Column:
    """Tokens of a score as array: arranged for the cello and spelled anew if the target clef is bass, else as read."""
    parts = F.transform(P.tokens_in(text), P.token_parts)
    kept = F.transform(parts, lambda n: P.token(n["step"], n["alter"], n["octave"]))
    arranged = F.transform(parts, lambda n: P.mixed_name(P.cello(P.midi(n["step"], n["alter"], n["octave"]))))
    return F.when(to_clef == "bass", arranged).otherwise(kept)


def measures(scores: DataFrame, beats: int = BEATS) -> DataFrame:
    """(score_id, measure from 1, slot from 0, token) of scores (score_id, tokens array): null tokens are rests.

    Measures hold ``beats`` notes; rests fill the last one, and a score without notes is one measure of rests.
    """
    slots = F.greatest(F.lit(1), F.ceil(F.size("tokens") / beats).cast("int")) * beats
    rows = scores.select("score_id", "tokens", F.explode(F.sequence(F.lit(0), slots - 1)).alias("i"))
    return rows.select("score_id", (F.floor(F.col("i") / beats) + 1).cast("int").alias("measure"), (F.col("i") % beats).alias("slot"), F.get("tokens", F.col("i")).alias("token"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name: str, *inside: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.lit(x) if isinstance(x, str) else x for x in inside], F.lit(f"</{name.split(' ')[0]}>"))


def musicxml(tokens: Column, to_clef: Column, title: Column, beats: int = BEATS, fifths: int = KEY_FIFTHS) -> Column:
    """MusicXML text of a score; one quarter a note, attributes in the first measure.

    One expression a row: measures are assembled from the token array, so nothing is shuffled.
    """
    sign = F.try_element_at(F.create_map(*[F.lit(x) for c, v in P.CLEFS.items() for x in (c, v[0])]), to_clef)
    line = F.try_element_at(F.create_map(*[F.lit(x) for c, v in P.CLEFS.items() for x in (c, str(v[1]))]), to_clef)
    attributes = _element(
        "attributes", _element("divisions", str(DIVISIONS)), _element("key", _element("fifths", str(fifths))),
        _element("time", _element("beats", str(beats)), _element("beat-type", str(BEAT_TYPE))),
        _element("clef", _element("sign", sign), _element("line", line)),
    )
    length = _element("duration", "1"), _element("type", "quarter")

    def note(written: Column) -> Column:
        step, accidental, octave = (F.regexp_extract(written, P.TOKEN, i) for i in (1, 2, 3))
        alter = F.when(accidental == "", "").otherwise(_element("alter", P.alter_of(accidental).cast("string")))
        pitch = _element("pitch", _element("step", step), alter, _element("octave", octave))
        return F.when(written.isNull(), _element("note", "<rest />", *length)).otherwise(_element("note", pitch, *length))

    count = F.greatest(F.lit(1), F.ceil(F.size(tokens) / beats).cast("int"))

    def measure(m: Column) -> Column:
        inside = F.transform(F.sequence(F.lit(0), F.lit(beats - 1)), lambda i: note(F.get(tokens, m * beats + i)))
        head = F.concat(F.lit('<measure number="'), (m + 1).cast("string"), F.lit('">'), F.when(m == 0, attributes).otherwise(""))
        return F.concat(head, F.array_join(inside, ""), F.lit("</measure>"))

    body = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), measure), "")
    return F.concat(
        F.lit("<?xml version='1.0' encoding='utf-8'?>\n<score-partwise version=\"4.0\">"),
        _element("work", _element("work-title", _escaped(title))),
        _element("identification", _element("encoding", _element("software", SOFTWARE))),
        F.lit('<part-list><score-part id="P1">'), _element("part-name", P.part_name(to_clef)), F.lit('</score-part></part-list><part id="P1">'),
        body, F.lit("</part></score-partwise>"),
    )


def adapted(scores: DataFrame) -> DataFrame:
    """Adapted scores of (score_id, notes_text, from_clef, to_clef, title): tokens, positions, note_count, musicxml, message."""
    rows = scores.withColumn("tokens", score_tokens(F.col("notes_text"), F.col("to_clef")))
    place = F.transform("tokens", lambda t: P.staff_position(P.token_parts(t)["step"], P.token_parts(t)["octave"], F.col("to_clef")))
    text = musicxml(F.col("tokens"), F.col("to_clef"), F.col("title"))
    message = F.when(F.size("tokens") > 0, "Generated MusicXML from structured score data").otherwise("No notes available for MusicXML generation")
    return rows.withColumns({"note_count": F.size("tokens"), "positions": place, "musicxml": text, "message": message})


def write_musicxml(scores: DataFrame, path: str) -> None:
    """Text files of MusicXML, one line of header and one of score each."""
    scores.select(F.col("musicxml").alias("value")).write.text(path, lineSep="\n\n")


def translated(lines: DataFrame, from_clef: str, to_clef: str) -> DataFrame:
    """The command line's translate mode over (line_id, line): one row a token, with its place in both clefs."""
    rows = _cli_notes(lines)
    name = P.token(F.col("n.letter"), F.col("n.accidental"), F.col("n.octave"))
    places = [P.staff_position_text(F.col("n.letter"), F.col("n.octave"), F.lit(c)) for c in (from_clef, to_clef)]
    return rows.select("line_id", "seq", name.alias("pitch"), "n.midi", places[0].alias("from_position"), places[1].alias("to_position"), F.lit("preserved pitch, changed clef only").alias("rule"), "n.error")


def arranged(lines: DataFrame) -> DataFrame:
    """The command line's arrange mode over (line_id, line): one row a token, moved into the cello's range."""
    rows = _cli_notes(lines).withColumn("to", P.cello(F.col("n.midi")))
    return rows.select("line_id", "seq", "n.input", "n.midi", P.sharp_name(F.col("to")).alias("output"), F.col("to").alias("output_midi"), P.shift_rule(F.col("n.midi")).alias("rule"), "n.error")


def report(rows: DataFrame) -> Column:
    """The arrange mode's text for one token."""
    return F.format_string("Input:  %s (%d)\nOutput: %s (%d)\nRule:   %s\n\n", "input", "midi", "output", "output_midi", "rule")


def _cli_notes(lines: DataFrame) -> DataFrame:
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    return lines.select("line_id", F.posexplode(words).alias("seq", "word")).withColumn("n", P.cli_note(F.col("word")))
