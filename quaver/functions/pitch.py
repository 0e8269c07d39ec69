"""Pitch tokens, MIDI numbers and staff positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note letters with their semitones, black-key spellings, clefs, ranges and patterns.
LETTERS = "CDEFGAB"
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
MIXED_NAMES = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
SHARP_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
CLEFS = {"treble": ("G", 2, "E", 4), "bass": ("F", 4, "G", 2), "alto": ("C", 3, "F", 3)}
ALTERS = {-2: "bb", -1: "b", 0: "", 1: "#", 2: "##"}
CELLO_LOW, CELLO_COMFORT = 36, 69
PIANO_LOW, PIANO_HIGH = 21, 108
TOKEN = r"\b([A-Ga-g])([#b]?)(-?[0-9]+)\b"
STRICT_TOKEN = r"^([A-G])([#b]?)(-?[0-9]+)$"
CLI_TOKEN = r"^([A-Ga-g])([#bB]?)[ \t\r\n]*([+-]?[0-9]+)"


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def semitone(letter: Column) -> Column:
    return _lookup(SEMITONES, F.upper(letter))


def diatonic(letter: Column) -> Column:
    """0 for C to 6 for B."""
    return _lookup({c: i for i, c in enumerate(LETTERS)}, F.upper(letter))


def alter_of(accidental: Column) -> Column:
    return F.when(accidental == "#", 1).when(F.lower(accidental) == "b", -1).otherwise(0)


def alter_suffix(alter: Column) -> Column:
    """Accidental of an alteration from -2 to 2, otherwise none."""
    return F.coalesce(_lookup(ALTERS, alter.cast("int")), F.lit(""))


def midi(letter: Column, alter: Column, octave: Column) -> Column:
    return (octave + 1) * 12 + semitone(letter) + alter


def token(letter: Column, alter: Column, octave: Column) -> Column:
    accidental = F.when(alter == 1, "#").when(alter == -1, "b").otherwise("")
    return F.concat(F.upper(letter), accidental, octave.cast("string"))


def tokens_in(text: Column) -> Column:
    """Pitch tokens of a text from left to right, as they are written, repeats included. ASCII digits only."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_parts(written: Column) -> Column:
    """struct<step, alter, octave> of one token as tokens_in() gives it."""
    step, accidental, octave = (F.regexp_extract(written, TOKEN, i) for i in (1, 2, 3))
    return F.struct(F.upper(step).alias("step"), alter_of(accidental).alias("alter"), octave.try_cast("int").alias("octave"))


def normal_tokens(text: Column) -> Column:
    """Tokens of a text with upper-case letters, each once, in order of first occurrence."""
    upper = F.transform(tokens_in(text), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 100)))
    return F.array_distinct(upper)


def strict_midi(written: Column) -> Column:
    """MIDI number of a token, null unless it is one upper-case letter, at most one accidental and an octave."""
    clean = trimmed(written)
    letter, accidental, octave = (F.regexp_extract(clean, STRICT_TOKEN, i) for i in (1, 2, 3))
    return F.when(clean.rlike(STRICT_TOKEN), midi(letter, alter_of(accidental), octave.try_cast("int")))


def cli_note(written: Column) -> Column:
    """struct<input, letter, accidental, octave, midi, error> of a command-line token.

    'B' after the letter is a flat too, and what follows the octave is ignored. Where the token is no note, error says
    why and the rest is null: one bad token does not stop the others.
    """
    clean = F.regexp_replace(written, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    letter, accidental, octave = (F.regexp_extract(clean, CLI_TOKEN, i) for i in (1, 2, 3))
    error = (
        F.when(F.length(clean) < 2, F.concat(F.lit("Note is too short: "), written))
        .when(clean.rlike("^.[#bB]$"), F.concat(F.lit("Missing octave in note: "), written))
        .when(~clean.rlike("^[A-Ga-g]"), F.lit("Invalid note letter."))
        .when(~clean.rlike(CLI_TOKEN) | octave.try_cast("int").isNull(), F.concat(F.lit("No octave number in note: "), written))
    )
    good = error.isNull()
    return F.struct(
        clean.alias("input"),
        F.when(good, F.upper(letter)).alias("letter"),
        F.when(good, alter_of(accidental)).alias("accidental"),
        F.when(good, octave.try_cast("int")).alias("octave"),
        F.when(good, midi(letter, alter_of(accidental), octave.try_cast("int"))).alias("midi"),
        error.alias("error"),
    )


def _name(number: Column, names: tuple[str, ...], octave: Column) -> Column:
    pitch = F.get(F.array(*[F.lit(n) for n in names]), F.pmod(number, F.lit(12)).cast("int"))
    return F.concat(pitch, octave.cast("string"))


def mixed_name(number: Column) -> Column:
    """Token of a MIDI number, black keys spelled C# Eb F# Ab Bb."""
    return _name(number, MIXED_NAMES, F.floor(number / 12) - 1)


def sharp_name(number: Column) -> Column:
    """Token of a MIDI number, black keys spelled with sharps. The octave is cut toward zero."""
    return _name(number, SHARP_NAMES, F.when(number < 0, F.ceil(number / 12)).otherwise(F.floor(number / 12)) - 1)


def cello(number: Column) -> Column:
    """MIDI number moved by octaves to at most A4 (but no lower than C2) and at least C2; always in 36..69."""
    down = CELLO_COMFORT - 11 + F.pmod(number - (CELLO_COMFORT - 11), F.lit(12))
    up = CELLO_LOW + F.pmod(number - CELLO_LOW, F.lit(12))
    return F.when(number > CELLO_COMFORT, down).when(number < CELLO_LOW, up).otherwise(number)


def shift_rule(number: Column) -> Column:
    return F.when(cello(number) != number, "shifted by octave for cello comfort").otherwise("kept original pitch")


def known_clef(clef: Column) -> Column:
    return clef.isin(*CLEFS)


def clef_or_treble(clef: Column) -> Column:
    return F.when(known_clef(clef), clef).otherwise("treble")


def parsed_clef(name: Column) -> Column:
    """The clef of a name; another name fails the query, null stays null."""
    return F.when(name.isNull() | known_clef(name), name).otherwise(F.raise_error(F.concat(F.lit("Unknown clef: "), name)))


def bottom_index(clef: Column) -> Column:
    """Diatonic number (7 an octave) of a clef's bottom line; null for an unknown clef."""
    return _lookup({c: 7 * octave + LETTERS.index(step) for c, (_, _, step, octave) in CLEFS.items()}, clef)


def _height(letter: Column, octave: Column, clef: Column) -> Column:
    return octave * 7 + diatonic(letter) - bottom_index(clef)


def staff_position(letter: Column, octave: Column, clef: Column) -> Column:
    """Where a note lies on a clef's staff, in few words; accidentals do not matter."""
    r = _height(letter, octave, clef)
    return _position(r, "line ", "space ", "", " ledger line", "")


def staff_position_text(letter: Column, octave: Column, clef: Column) -> Column:
    """Where a note lies on a clef's staff, in full words."""
    r = _height(letter, octave, clef)
    return _position(r, "line ", "space ", " of the staff", " ledger line(s)", " the staff")


def _position(r: Column, line: str, space: str, inside: str, ledger: str, outside: str) -> Column:
    number = (F.floor(r / 2) + 1).cast("string")
    on = F.concat(F.when(r % 2 == 0, line).otherwise(space), number, F.lit(inside))
    away = F.when(r < 0, -r).otherwise(r - 8)
    side = F.when(r < 0, " below").otherwise(" above")
    off = F.when(away % 2 == 0, F.concat(F.floor(away / 2).cast("string"), F.lit(ledger), side, F.lit(outside)))
    return F.when(r.isNull(), None).when((r >= 0) & (r <= 8), on).otherwise(F.coalesce(off, F.concat(F.lit("ledger space"), side, F.lit(outside))))


def step_token(step: Column, clef: Column) -> Column:
    """Natural token of a diatonic step above the bottom line."""
    index = bottom_index(clef) + step
    letter = F.get(F.array(*[F.lit(c) for c in LETTERS]), F.pmod(index, F.lit(7)).cast("int"))
    return F.concat(letter, F.floor(index / 7).cast("string"))


def part_name(clef: Column) -> Column:
    return F.when(clef == "bass", "Cello").otherwise("Converted Part")


def suffix(name: Column) -> Column:
    """Lower-case file suffix with its dot, or nothing."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^/.]+)$", 1))
