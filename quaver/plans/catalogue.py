"""Queries over the derived music relations, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import pitch as P
from quaver.operators import calibrate, detect, gate, musicxml, reader, score, signal
from quaver.sources import corpus, derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# SQL spellings of what functions/pitch.py says in columns.
_SEMI = "case {0} when 'C' then 0 when 'D' then 2 when 'E' then 4 when 'F' then 5 when 'G' then 7 when 'A' then 9 when 'B' then 11 end"
_INDEX = "(instr('CDEFGAB', {0}) - 1)"
_CELLO = "case when {0} > 69 then 58 + (({0} - 58) % 12 + 12) % 12 when {0} < 36 then 36 + (({0} - 36) % 12 + 12) % 12 else {0} end"
_MIXED = "['C','C#','D','Eb','E','F','F#','G','Ab','A','Bb','B'][(({0}) % 12 + 12) % 12 + 1] || cast(cast(floor(({0}) / 12.0) - 1 as bigint) as varchar)"
_SHARP = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][(({0}) % 12 + 12) % 12 + 1] || cast(({0}) // 12 - 1 as varchar)"
_BOTTOM = "case {0} when 'treble' then 30 when 'bass' then 18 when 'alto' then 24 end"
_SHORT = """case when {0} between 0 and 8 then case when {0} % 2 = 0 then 'line ' else 'space ' end || cast({0} // 2 + 1 as varchar)
    when {0} < 0 then case when {0} % 2 = 0 then cast(-{0} // 2 as varchar) || ' ledger line below' else 'ledger space below' end
    else case when {0} % 2 = 0 then cast(({0} - 8) // 2 as varchar) || ' ledger line above' else 'ledger space above' end end"""
_LONG = """case when {0} between 0 and 8 then case when {0} % 2 = 0 then 'line ' else 'space ' end || cast({0} // 2 + 1 as varchar) || ' of the staff'
    when {0} < 0 then case when {0} % 2 = 0 then cast(-{0} // 2 as varchar) || ' ledger line(s) below the staff' else 'ledger space below the staff' end
    else case when {0} % 2 = 0 then cast(({0} - 8) // 2 as varchar) || ' ledger line(s) above the staff' else 'ledger space above the staff' end end"""
_CLEFS = "(values ('treble'), ('bass'), ('alto')) c(clef)"
_TOKEN_MIDI = f"(octave + 1) * 12 + {_SEMI.format('step')} + case acc when '#' then 1 when 'b' then -1 else 0 end"


def _with(*names: str, rest: str) -> str:
    return "with " + ", ".join(f"{n} as ({derived.SQL[n]})" for n in names) + " " + rest


def _query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _clefs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("clef", F.explode(F.array(*[F.lit(c) for c in P.CLEFS])))


def _alter() -> F.Column:
    return P.alter_of(F.col("acc"))


def _longs(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("long") for n in names})


@_query(_with("notes", rest=f"select phrase_id, seq, midi, cast({_CELLO.format('midi')} as bigint) as arranged_midi, {_MIXED.format(_CELLO.format('midi'))} as token from notes"))
def arrange_cello(spark, sf_dir):
    to = P.cello(F.col("midi"))
    return derived.notes(spark, sf_dir).select("phrase_id", "seq", "midi", to.cast("long").alias("arranged_midi"), P.mixed_name(to).alias("token"))


@_query(
    _with(
        "tokens",
        rest=f"""select phrase_id, seq - 1 as seq, input, midi, {_SHARP.format(_CELLO.format('midi'))} as output, cast({_CELLO.format('midi')} as bigint) as output_midi,
    case when {_CELLO.format('midi')} <> midi then 'shifted by octave for cello comfort' else 'kept original pitch' end as rule, cast(null as varchar) as error
    from (select phrase_id, seq, step || acc || octave as input, cast({_TOKEN_MIDI} as bigint) as midi from tokens)""",
    )
)
def arrange_cli_sharp(spark, sf_dir):
    lines = derived.texts(spark, sf_dir).select(F.col("phrase_id").alias("line_id"), F.col("text").alias("line"))
    rows = score.arranged(lines).withColumnRenamed("line_id", "phrase_id")
    return _longs(rows, "seq", "midi", "output_midi")


@_query(
    _with(
        "tokens",
        rest=f"select phrase_id, seq, clef, step || acc || octave as token, {_SHORT.format('r')} as position from (select *, octave * 7 + {_INDEX.format('step')} - {_BOTTOM.format('clef')} as r from tokens, {_CLEFS})",
    )
)
def staff_position_short(spark, sf_dir):
    rows = _clefs(derived.tokens(spark, sf_dir))
    return rows.select("phrase_id", "seq", "clef", P.token(F.col("step"), _alter(), F.col("octave")).alias("token"), P.staff_position(F.col("step"), F.col("octave"), F.col("clef")).alias("position"))


@_query(_with("tokens", rest=f"select phrase_id, seq, clef, {_LONG.format('r')} as position from (select *, octave * 7 + {_INDEX.format('step')} - {_BOTTOM.format('clef')} as r from tokens, {_CLEFS})"))
def staff_position_long(spark, sf_dir):
    return _clefs(derived.tokens(spark, sf_dir)).select("phrase_id", "seq", "clef", P.staff_position_text(F.col("step"), F.col("octave"), F.col("clef")).alias("position"))


@_query(
    _with(
        "tokens",
        rest=f"""select phrase_id, seq - 1 as seq, step || acc || octave as pitch, cast({_TOKEN_MIDI} as bigint) as midi, {_LONG.format('(h - 30)')} as from_position,
    {_LONG.format('(h - 18)')} as to_position, 'preserved pitch, changed clef only' as rule, cast(null as varchar) as error from (select *, octave * 7 + {_INDEX.format('step')} as h from tokens)""",
    )
)
def translate_clefs(spark, sf_dir):
    lines = derived.texts(spark, sf_dir).select(F.col("phrase_id").alias("line_id"), F.col("text").alias("line"))
    rows = score.translated(lines, "treble", "bass").withColumnRenamed("line_id", "phrase_id")
    return _longs(rows, "seq", "midi")


@_query(
    f"""select clef, step, substr('CDEFGAB', cast((i % 7 + 7) % 7 + 1 as int), 1) || cast(cast(floor(i / 7.0) as bigint) as varchar) as token
    from (select clef, step, step + {_BOTTOM.format('clef')} as i from (select distinct cast(l_quantity as bigint) - 40 as step from lineitem), {_CLEFS})"""
)
def step_to_token(spark, sf_dir):
    steps = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity").cast("long") - 40).alias("step")).distinct()
    return _clefs(steps).select("clef", "step", P.step_token(F.col("step"), F.col("clef")).alias("token"))


@_query(_with("tokens", rest=f"select phrase_id, seq - 1 as seq, step, cast(case acc when '#' then 1 when 'b' then -1 else 0 end as bigint) as alter, octave, cast({_TOKEN_MIDI} as bigint) as midi from tokens"))
def parse_tokens(spark, sf_dir):
    texts = derived.texts(spark, sf_dir).select(F.col("phrase_id").alias("score_id"), F.col("text").alias("notes_text"))
    return _longs(score.notes(texts).withColumnRenamed("score_id", "phrase_id"), "seq", "alter", "octave", "midi")


@_query(
    _with(
        "tokens",
        rest="""select phrase_id, row_number() over (partition by phrase_id order by first) as place, token from
    (select phrase_id, step || acc || octave as token, min(seq) as first from tokens group by all)""",
    )
)
def distinct_tokens(spark, sf_dir):
    rows = derived.texts(spark, sf_dir).select("phrase_id", F.posexplode(P.normal_tokens(F.lower("text"))).alias("place", "token"))
    return rows.select("phrase_id", (F.col("place") + 1).cast("long").alias("place"), "token")


@_query(_with("tokens", rest=f"select phrase_id, seq, step || acc || case when twice then acc else '' end || octave as token, cast(case when not twice or acc = '' then {_TOKEN_MIDI} end as bigint) as midi from tokens"))
def token_midi_strict(spark, sf_dir):
    t = F.concat("step", "acc", F.when(F.col("twice"), F.col("acc")).otherwise(""), F.col("octave").cast("string"))
    return derived.tokens(spark, sf_dir).select("phrase_id", "seq", t.alias("token"), P.strict_midi(t).cast("long").alias("midi"))


_LEAPS = "select phrase_id, seq, abs(midi - lag(midi) over (partition by phrase_id order by seq)) as leap from notes"


@_query(_with("notes", rest=f"select * from ({_LEAPS}) where leap is not null"))
def leaps(spark, sf_dir):
    return gate.leaps(derived.notes(spark, sf_dir), "phrase_id")


@_query(_with("notes", rest=f"select phrase_id, count(leap) as n, count(*) filter (where leap > 24) as wide from ({_LEAPS}) group by phrase_id having count(leap) > 0"))
def wild_leaps(spark, sf_dir):
    rows = gate.leaps(derived.notes(spark, sf_dir), "phrase_id")
    return rows.groupBy("phrase_id").agg(F.count("leap").alias("n"), F.count_if(F.col("leap") > gate.WIDE_LEAP).alias("wide"))


_SLOTS = """, sized as (select o_orderkey as score_id, count(phrase_id) as n from orders left join tokens on phrase_id = o_orderkey group by o_orderkey),
    slots as (select score_id, unnest(range(0, cast(greatest(1, ceil(n / 4.0)) * 4 as bigint))) as i from sized)
    select score_id, i // 4 + 1 as measure, i % 4 as slot, step || acc || octave as token from slots left join tokens on phrase_id = score_id and seq = i + 1"""


@_query(_with("tokens", rest="").rstrip() + _SLOTS)
def measure_slots(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("score_id"))
    texts = derived.texts(spark, sf_dir)
    rows = orders.join(texts, F.col("score_id") == F.col("phrase_id"), "left")
    rows = rows.select("score_id", score.score_tokens(F.coalesce("text", F.lit("")), F.lit("treble")).alias("tokens"))
    return _longs(score.measures(rows), "measure", "slot")


@_query(_with("tokens", rest=f"select phrase_id, seq - 1 as seq, {_MIXED.format(_CELLO.format('m'))} as token from (select phrase_id, seq, {_TOKEN_MIDI} as m from tokens)"))
def musicxml_roundtrip(spark, sf_dir):
    """Texts become scores for the bass clef, those MusicXML, and that is read again."""
    texts = derived.texts(spark, sf_dir)
    made = score.adapted(texts.select(F.col("phrase_id").alias("score_id"), F.col("text").alias("notes_text"), F.lit("treble").alias("from_clef"), F.lit("bass").alias("to_clef"), F.lit("A & B <1>").alias("title")))
    rows = musicxml.tokens(made.select(F.col("score_id").alias("read_id"), "musicxml")).withColumnRenamed("read_id", "phrase_id")
    return _longs(rows, "seq")


@_query(
    _with(
        "tokens",
        rest=f"""select phrase_id as score_id, count(*) as note_count, string_agg({_MIXED.format('c')}, ' ' order by seq) as tokens from
    (select phrase_id, seq, {_CELLO.format('m')} as c from (select phrase_id, seq, {_TOKEN_MIDI} as m from tokens)) group by phrase_id""",
    )
)
def score_requests(spark, sf_dir):
    """JSON score requests with defaults: an empty target clef is bass."""
    texts = derived.texts(spark, sf_dir)
    bodies = texts.select(F.col("phrase_id").alias("score_id"), F.to_json(F.struct(F.col("text").alias("notes"), F.lit(" ").alias("to_clef"))).alias("body"))
    made = score.adapted(score.requests(bodies).where("error is null"))
    return made.select("score_id", F.col("note_count").cast("long").alias("note_count"), F.array_join("tokens", " ").alias("tokens"))


_COHERENCE = """, carried as (select read_id, duration, last_value(divisions ignore nulls) over w as d, last_value(beats ignore nulls) over w as b, last_value(beat_type ignore nulls) over w as t
    from measures window w as (partition by read_id order by part, measure rows between unbounded preceding and current row)),
    sums as (select read_id, count(*) filter (where abs(duration - due) > greatest(1e0, 0.1e0 * due)) as bad, count(*) as total
        from (select read_id, duration, cast(d * b * 4 as double) / t as due from carried where d > 0 and b > 0 and t > 0) group by read_id)"""


@_query(_with("measures", rest="").rstrip() + _COHERENCE + " select * from sums")
def measure_arithmetic(spark, sf_dir):
    return musicxml.coherence(derived.measures(spark, sf_dir))


_GRADES = """select read_id, count(*) as head_count, cast(sum(ctx) as double) / count(*) as mean_ctx, min(ctx) as min_ctx, cast(sum(grade) as double) / count(*) as mean_grade,
    min(grade) as min_grade, count(*) filter (where ctx < 350) as weak from heads group by read_id"""


@_query(_with("heads", rest=_GRADES))
def grade_summary(spark, sf_dir):
    """Grades are whole thousandths here, so that means are exact in any order of summing."""
    rows = derived.heads(spark, sf_dir)
    exact = rows.select("read_id", F.col("ctx"), F.col("grade"))
    found = gate.grade_summary(exact.select("read_id", (F.col("ctx") / 1000).alias("ctx"), (F.col("grade") / 1000).alias("grade"))).select("read_id", "weak")
    means = gate.grade_summary(exact).drop("weak")
    return means.join(found, "read_id").select("read_id", "head_count", "mean_ctx", "min_ctx", "mean_grade", "min_grade", "weak")


def _reads(spark, sf_dir):
    """Reads with tokens, measure sums and grades: phrase and customer numbers meet as read numbers."""
    lists = derived.texts(spark, sf_dir).select(F.col("phrase_id").alias("read_id"), F.split("text", " ").alias("tokens"))
    sums = musicxml.coherence(derived.measures(spark, sf_dir))
    exact = [(F.col(c) / 1000).cast("decimal(4,3)").alias(c) for c in ("ctx", "grade")]  # means are the same in any order of summing
    grades = gate.grade_summary(derived.heads(spark, sf_dir).select("read_id", *exact))
    grades = grades.withColumns({"mean_ctx": gate.rounded(F.col("mean_ctx")).cast("double"), "min_ctx": F.col("min_ctx").cast("double")})
    return lists.join(sums, "read_id", "left").join(grades, "read_id", "left")


_PERCENT = "cast(cast(round_even(100 * ({0}), 0) as bigint) as varchar) || '%'"
_DETAILS = f"""n || ' note(s)' as d0, case when within then 'all within A0–C8' else 'a note is out of range' end as d1,
    {_PERCENT.format("case when leaps > 0 then wide / cast(leaps as double) else 0e0 end")} || ' of steps leap >2 octaves' as d2,
    coalesce(bad, 0) || '/' || coalesce(total, 0) || ' measures don''t add up (allowed ≤0.5)' as d3,
    case when head_count is null then 'no grade data available' else 'mean ctx-grade ' || printf('%.2f', round_even(mean_ctx, 0) / 1000e0) || ' (min ' || printf('%.2f', min_ctx / 1000e0) || '), '
        || {_PERCENT.format("weak / cast(head_count as double)")} || ' below 0.35; need mean ≥0.55' end as d4"""
_CHECKS = (
    _COHERENCE
    + f""", grades as ({_GRADES}), midis as (select phrase_id as read_id, seq, {_TOKEN_MIDI} as midi from tokens),
    jumps as (select read_id, midi, abs(midi - lag(midi) over (partition by read_id order by seq)) as leap from midis),
    facts as (select read_id, count(*) as n, bool_and(midi between 21 and 108) as within, count(leap) as leaps, count(*) filter (where leap > 24) as wide from jumps group by read_id),
    checks as (select f.read_id, {_DETAILS}, n >= 2 as c0, within as c1, leaps = 0 or wide < 0.5e0 * leaps as c2, not (coalesce(total, 0) >= 2 and bad > 0.5e0 * total) as c3,
        head_count is null or (round_even(mean_ctx, 0) >= 550 and weak <= 0.5e0 * head_count) as c4 from facts f left join sums s on f.read_id = s.read_id left join grades g on f.read_id = g.read_id)"""
)
_REASON = "concat_ws('; ', case when not c0 then 'note_count [tokens]: ' || d0 end, case when not c1 then 'pitch_range [tokens]: ' || d1 end, case when not c2 then 'erratic_leaps [tokens]: ' || d2 end, case when not c3 then 'measure_arithmetic [musicxml]: ' || d3 end, case when not c4 then 'engine_grades [engine]: ' || d4 end)"
_PATH = """select read_id, cast(ord as bigint) as ord, ['note_count', 'pitch_range', 'erratic_leaps', 'measure_arithmetic', 'engine_grades'][ord + 1] as "check",
    [c0, c1, c2, c3, c4][ord + 1] as ok, [d0, d1, d2, d3, d4][ord + 1] as detail, ['tokens', 'tokens', 'tokens', 'musicxml', 'engine'][ord + 1] as source from checks, (select unnest(range(0, 5)) as ord)"""


@_query(_with("measures", "tokens", "heads", rest="").rstrip() + _CHECKS + " select read_id, c0 and c1 and c2 and c3 and c4 as ok, cast(5 - c0::int - c1::int - c2::int - c3::int - c4::int as bigint) as failed, " + _REASON + " as reason from checks")
def confidence_gate(spark, sf_dir):
    rows = gate.assessed(_reads(spark, sf_dir))
    return rows.select("read_id", "ok", F.size(F.filter("decision_path", lambda c: ~c["ok"])).cast("long").alias("failed"), "reason")


@_query(_with("measures", "tokens", "heads", rest="").rstrip() + _CHECKS + " " + _PATH)
def decision_path(spark, sf_dir):
    return _longs(gate.path_rows(gate.assessed(_reads(spark, sf_dir))), "ord")


@_query(
    """select cast(coalesce(min(c), 0.55e0) as double) as ctx_mean_min, cast(coalesce(min(m), 0.5e0) as double) as measure_bad_fraction,
    coalesce('calibrated (' || min(path) || ')', 'fallback (hand-set guesses)') as source from
    (select * from (select 'p' || cast(p_partkey as varchar) as path, p_partkey, (p_size - 20) / 10e0 as c, p_size / 20e0 as m from part) where c between 0 and 1 and m between 0 and 1.01e0 order by p_partkey limit 1)"""
)
def gate_params_precedence(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.col("p_partkey").alias("priority"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), ((F.col("p_size") - 20) / 10.0).cast("string").alias("ctx_mean_min"), (F.col("p_size") / 20.0).cast("string").alias("measure_bad_fraction"))
    return gate.thresholds(rows)


_AGREE = """select phrase_id, cast(levenshtein(truth, read) as bigint) as distance, case when length(truth) = 0 and length(read) = 0 then 1e0 when length(truth) = 0 or length(read) = 0 then 0e0
    else 1e0 - levenshtein(truth, read) / cast(greatest(length(truth), length(read)) as double) end as agreement from pairs"""


@_query(_with("pairs", rest=f"select *, agreement >= 0.85e0 as should_accept from ({_AGREE})"))
def agreement(spark, sf_dir):
    rows = calibrate.scored(derived.pairs(spark, sf_dir))
    return rows.select("phrase_id", calibrate.edit_distance(F.col("truth"), F.col("read")).cast("long").alias("distance"), "agreement", "should_accept")


@_query(
    _with("measures", "tokens", "heads", rest="").rstrip()
    + _CHECKS
    + """ select f.read_id, n as note_count, case when leaps > 0 then round_even(wide / cast(leaps as double), 3) else 0e0 end as wild_frac,
    case when total > 0 then round_even(bad / cast(total as double), 3) else 0e0 end as measures_bad_frac, coalesce(total, 0) as measures_total, round_even(mean_ctx, 0) / 1000e0 as mean_ctx,
    min_ctx / 1000e0 as min_ctx, head_count, round_even(weak / cast(head_count as double), 3) as weak_frac from facts f left join sums s on f.read_id = s.read_id left join grades g on f.read_id = g.read_id"""
)
def feature_vector(spark, sf_dir):
    rows = calibrate.features(_reads(spark, sf_dir)).select("read_id", "features.*")
    return _longs(rows, "note_count", "measures_total", "head_count")


@_query(
    _with("pairs", rest="").rstrip()
    + f""", read_ as (select *, phrase_id % 7 <> 0 as out_ from pairs), made as (select r.phrase_id, out_, case when out_ then read else '' end as read, a.agreement from read_ r join ({_AGREE}) a on r.phrase_id = a.phrase_id)
    select phrase_id, 'q' || phrase_id % 3 as quality, out_ as audiveris_ok, cast(length(read) as bigint) as n, case when out_ then round_even(agreement, 3) else 0e0 end as agreement,
    out_ and agreement >= 0.85e0 as should_accept, case when out_ then cast(length(read) as bigint) end as note_count, case when not out_ then 'no output of ' || phrase_id end as note from made"""
)
def collected_dataset(spark, sf_dir):
    """Reads with a manifest to dataset rows: every seventh image has no output. Numbers stand for pitches, so tokens are named ones."""
    pairs = derived.pairs(spark, sf_dir).withColumn("image", F.concat(F.lit("i"), F.col("phrase_id").cast("string")))
    named = lambda c: F.transform(c, P.mixed_name)
    manifest = pairs.select("image", F.col("phrase_id").cast("string").alias("piece"), F.concat(F.lit("q"), (F.col("phrase_id") % 3).cast("string")).alias("quality"), named("truth").alias("gt_tokens"), F.col("truth").alias("gt_midi"))
    none = F.lit(None)
    reads = pairs.select("image", F.when(F.col("phrase_id") % 7 != 0, named("read")).alias("tokens"), none.cast("int").alias("bad"), none.cast("int").alias("total"), none.cast("int").alias("head_count"), none.cast("double").alias("mean_ctx"), none.cast("double").alias("min_ctx"), none.cast("int").alias("weak"), F.concat(F.lit("no output of "), F.col("phrase_id").cast("string")).alias("note"))
    rows = calibrate.collected(manifest, reads)
    return rows.select(F.col("piece").cast("long").alias("phrase_id"), "quality", "audiveris_ok", F.size("notes").cast("long").alias("n"), "agreement", "should_accept", F.col("features.note_count").cast("long").alias("note_count"), "note")


@_query(
    "select piece, quality, cast(len(string_split(notes, ' ')) as bigint) as n from (values "
    + ", ".join(f"('{k}', '{v}')" for k, v in corpus.PIECES.items())
    + ") p(piece, notes), (values "
    + ", ".join(f"('{q}')" for q in corpus.QUALITIES)
    + ") q(quality)"
)
def corpus_cross(spark, sf_dir):
    return corpus.labelled(spark).select("piece", "quality", F.size("gt_midi").cast("long").alias("n"))


_GRID = """, ts as (select row_number() over (order by t) - 1 as t_idx, t from (select 0e0 as t, -1 as o union all select v - 0.001e0, 0 from (select distinct round_even(mean_ctx, 3) as v from labeled) union all select 1.01e0, 1) ),
    ms as (select * from (values (0, 0e0), (1, 0.25e0), (2, 0.5e0), (3, 0.75e0), (4, 1.01e0)) m(m_idx, m)),
    points as (select t_idx, t, cast(m_idx as bigint) as m_idx, m,
        (select count(*) from labeled where should_accept and mean_ctx >= t and bad_frac <= m) as tp, (select count(*) from labeled where not should_accept and mean_ctx >= t and bad_frac <= m) as fp,
        (select count(*) from labeled where should_accept and not (mean_ctx >= t and bad_frac <= m)) as fn from ts, ms)"""


@_query(_with("labeled", rest="").rstrip() + _GRID.replace("order by t)", "order by o, t)") + " select t_idx, t, m_idx, m, tp, fp, fn from points")
def threshold_grid(spark, sf_dir):
    reads = derived.labeled(spark, sf_dir)
    return _longs(calibrate.confusion(reads, calibrate.grid(reads)).select("t_idx", "t", "m_idx", "m", "tp", "fp", "fn"), "t_idx", "m_idx")


@_query(
    _with("labeled", rest="").rstrip()
    + _GRID.replace("order by t)", "order by o, t)")
    + """ select round_even(least(greatest(t, 0e0), 1e0), 3) as ctx_mean_min, m as measure_bad_fraction, (select count(*) from labeled) as calibrated_on, cast(tp as varchar) || '/' || cast((select count(*) from labeled where should_accept) as varchar) as accepts_correct,
    cast(fp as varchar) || '/' || cast((select count(*) from labeled where not should_accept) as varchar) as accepts_wrong
    from points order by fp = 0 desc, tp desc, fn, t_idx, m_idx limit 1"""
)
def calibrate_gate(spark, sf_dir):
    return calibrate.calibrated(derived.labeled(spark, sf_dir))


@_query(_with("pixels", rest="select i.image_id, cast(level as bigint) as level, count(v) as n from (select distinct image_id from pixels) i cross join (select unnest(range(0, 256)) as level) left join pixels p on p.image_id = i.image_id and p.v = level group by all"))
def histogram256(spark, sf_dir):
    return _longs(signal.histogram(derived.pixels(spark, sf_dir)), "level")


@_query(
    _with(
        "pixels",
        rest=""", h as (select i.image_id, level, count(v) as n from (select distinct image_id from pixels) i cross join (select unnest(range(0, 256)) as level) left join pixels p on p.image_id = i.image_id and p.v = level group by all),
    c as (select image_id, level, cast(sum(n) over w as double) as wb, cast(sum(n) over a as double) as w, cast(sum(level * n) over w as double) as sb, cast(sum(level * n) over a as double) as s
        from h window w as (partition by image_id order by level rows unbounded preceding), a as (partition by image_id)),
    g as (select image_id, level, case when wb = 0 or w - wb = 0 then -1e0 else wb * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) end as between_ from c)
    select image_id, cast(level as bigint) as threshold from (select *, row_number() over (partition by image_id order by between_ desc, level) as k from g) where k = 1""",
    ).replace(") , h as", "), h as")
)
def otsu_threshold(spark, sf_dir):
    return _longs(signal.otsu(signal.histogram(derived.pixels(spark, sf_dir))), "threshold")


_ISLANDS = """, gaps as (select {k}, {v}, case when {v} - lag({v}) over (partition by {k} order by {v}) > {g} then 1 else 0 end as new from {t}),
    numbered as (select {k}, {v}, sum(new) over (partition by {k} order by {v} rows unbounded preceding) as island from gaps)"""


@_query(
    _with("runs", rest="").rstrip()
    + _ISLANDS.format(k="grp", v="v", g=2, t="runs")
    + ' select grp, cast(island as bigint) as island, min(v) as "first", max(v) as "last", count(*) as n, avg(v) as centre from numbered group by grp, island'
)
def row_islands(spark, sf_dir):
    return signal.islands(derived.runs(spark, sf_dir))


@_query(
    _with("runs", rest=", picked as (select distinct grp as staff, v as x from runs where v % 7 < 2)").rstrip()
    + _ISLANDS.format(k="staff", v="x", g=2, t="picked")
    + " select staff, x from (select staff, (min(x) + max(x)) / 2e0 as x, max(x) - min(x) + 1 as wide from numbered group by staff, island) where wide <= 2 and x between 5 and 400"
)
def barlines(spark, sf_dir):
    columns = derived.runs(spark, sf_dir).select(F.col("grp").alias("staff"), F.col("v").alias("x"), F.when(F.col("v") % 7 < 2, 0.9).otherwise(0.5).alias("share"))
    staves = columns.select("staff").distinct().select("staff", F.lit(4.4).alias("spacing"), F.lit(5.0).alias("x_start"), F.lit(400.0).alias("x_end"))
    return signal.barlines(columns, staves)


@_query(
    _with(
        "runs",
        rest="""select grp, coalesce(min(v) filter (where blank > 3), max(v) + 1) as x from
    (select grp, v, v - lag(v) over (partition by grp order by v) - 1 as blank from runs) group by grp""",
    )
)
def content_start(spark, sf_dir):
    return signal.content_start(derived.runs(spark, sf_dir).withColumnRenamed("v", "x"), "grp")


@_query(
    _with(
        "pixels",
        rest=""", ink as (select image_id, pos, case when v > 120 then 1 else 0 end as ink from pixels),
    runs_ as (select image_id, pos, ink, pos - row_number() over (partition by image_id, ink order by pos) as run from ink)
    select image_id, pos, cast(ink as bigint) as ink, ink = 1 and count(*) over (partition by image_id, ink, run) >= 3 as open from runs_""",
    ).replace(") , ink as", "), ink as")
)
def opening_runs(spark, sf_dir):
    ink = derived.pixels(spark, sf_dir).select(F.col("image_id").alias("row"), F.col("pos").alias("x"), (F.col("v") > 120).cast("long").alias("ink"))
    return signal.opened(ink, 3).select(F.col("row").alias("image_id"), F.col("x").alias("pos"), "ink", (F.col("open") == 1).alias("open"))


@_query(
    _with("runs", rest="").rstrip()
    + _ISLANDS.format(k="grp", v="v", g=2, t="runs")
    + """, centres as (select grp, avg(v) as c from numbered group by grp, island), steps as (select grp, c - lag(c) over (partition by grp order by c) as gap from centres),
    base as (select grp, median(gap) as base from steps where gap >= 2 group by grp)
    select s.grp, median(gap) as spacing from steps s join base b on s.grp = b.grp where gap >= 2 and gap <= base * 1.8e0 group by s.grp"""
)
def line_gap_median(spark, sf_dir):
    return signal.gap_median(signal.islands(derived.runs(spark, sf_dir)))


@_query(
    _with(
        "pixels",
        rest="""select a.image_id, cast(b.pos - a.pos as bigint) as lag, cast(sum(a.v * b.v) as bigint) as total from pixels a join pixels b on a.image_id = b.image_id and b.pos - a.pos between 4 and 7 group by all""",
    )
)
def lag_correlation(spark, sf_dir):
    rows = derived.pixels(spark, sf_dir).select("image_id", F.col("pos").alias("at"), F.col("v").cast("long").alias("v"))
    return _longs(signal.lag_correlation(rows, "image_id", (4, 8)), "lag")


@_query(
    _with(
        "marks",
        rest=""", own as (select distinct staff, x, step from marks) select staff, x, cast(step as bigint) as step from own c where step < 10 or exists
    (select 1 from own o where o.staff = c.staff and (o.x <> c.x or o.step <> c.step) and abs(o.x - c.x) <= 3 and abs(o.step - c.step) <= 4)""",
    ).replace(") , own as", "), own as")
)
def tempo_antijoin(spark, sf_dir):
    own = derived.marks(spark, sf_dir).select("staff", "x", "step").distinct()
    found = signal.tempo_filtered(own.withColumn("id", F.struct("x", "step")))
    return _longs(found.drop("id"), "step")


@_query("select staff, step, x, 10 * staff - step * 2.5e0 as y from (select cast(s_suppkey as bigint) as staff from supplier), (select unnest(range(-5, 14)) as step), (select unnest(range(4, 61, 3)) as x)")
def candidate_grid(spark, sf_dir):
    staves = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("staff"), (F.col("s_suppkey") * 10).alias("bottom"), F.lit(5.0).alias("spacing"), F.lit(4).alias("left"), F.lit(60).alias("right"), F.lit(3).alias("stride"))
    return _longs(signal.candidate_grid(staves), "step", "x")


@_query(
    _with(
        "marks",
        rest="""select reason, score, accepted, logged, count(*) as n from (select reason, case when reason <> '' then 0e0 when stem then 0.85e0 else 0.7e0 end as score, reason = '' as accepted, reason <> '' and fill >= 0.3e0 as logged
    from (select *, case when wide > 2.6e0 then 'wide bar/beam' when wide < 0.55e0 then 'thin stroke (stem/accidental)' when tall < 0.6e0 then 'thin bar (beam)'
    when core >= 0.85e0 and fill between 0.42e0 and 0.95e0 then '' else 'weak/ambiguous fill (not a solid head)' end as reason from marks)) group by all""",
    )
)
def notehead_score(spark, sf_dir):
    rows = signal.notehead_scores(derived.marks(spark, sf_dir))
    return rows.groupBy("reason", "score", "accepted", "logged").agg(F.count(F.lit(1)).alias("n"))


@_query(
    """select doc_id as upload_id, case when mode = 'engine-omr' then 'C4' when mode = 'heuristic-detection' then 'D4 E4' when mode = 'text-ocr-fallback' then 'G5 Bb3' else '' end as notes,
    mode as detection_mode, mode in ('heuristic-detection', 'text-ocr-fallback') as fallback from (select d.doc_id, case when quality = 1 then 'engine-omr' when d.doc_id % 3 = 0 then 'heuristic-detection'
    when d.doc_id % 2 = 0 and d.doc_id % 5 <> 0 then 'text-ocr-fallback' else 'none' end as mode from documents d left join labels l on d.doc_id = l.doc_id)"""
)
def reader_fallback(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    rows = docs.join(labels, "doc_id", "left").select(
        i.alias("upload_id"), F.when(F.col("quality") == 1, F.array(F.lit("C4"))).alias("engine_notes"),
        F.when(i % 3 == 0, F.array(F.lit("D4"), F.lit("E4"))).otherwise(none).alias("heuristic_notes"),
        F.when(i % 2 == 0, 0).otherwise(2).alias("staff_count"), F.when(i % 5 == 0, "no notes").otherwise("g5, Bb3 and g5").alias("raw_text"),
    )
    return reader.chosen(rows).select("upload_id", F.array_join("notes", " ").alias("notes"), "detection_mode", "fallback")


@_query(
    _with(
        "marks",
        rest="""select staff, m.x as x, m.y as y, m.fill as fill from (select staff, unnest(list_reduce(list_transform(l, lambda m: [m]), lambda kept, e:
        case when len(list_filter(kept, lambda k: abs(k.x - e[1].x) < 0.7e0 and abs(k.y - e[1].y) < 0.8e0)) > 0 then kept else list_concat(kept, e) end)) as m
        from (select staff, list({'x': cast(x as double), 'y': (-step) / 2e0, 'fill': fill} order by fill desc, x, step) as l from marks group by staff))""",
    )
)
def suppressed_marks(spark, sf_dir):
    """Greedy suppression per staff."""
    rows = derived.marks(spark, sf_dir).select("staff", F.struct("x", "step").alias("id"), F.col("x").cast("double").alias("x"), (-F.col("step") / 2.0).alias("y"), "fill")
    return signal.suppressed(rows, 0.70, 0.80).select("staff", "x", "y", "fill")


def _drawn(rows: int, seed: int) -> np.ndarray:
    """A page with one staff, a clef-like block and solid noteheads with stems; spacing 20."""
    page = np.full((300, 1200), 255, dtype=np.uint8)
    lines = [100 + 20 * k for k in range(5)]
    for y in lines:
        page[y - 1 : y + 2, 40:1160] = 0
    page[90:190, 50:100] = 0
    yy, xx = np.mgrid[0:300, 0:1200]
    for i in range(rows):
        x, step = 220 + 100 * i, (seed * (i + 3)) % 9
        y = 180 - step * 10
        page[((xx - x) / 12.5) ** 2 + ((yy - y) / 9.5) ** 2 <= 1] = 0
        page[max(0, y - 60) : y, x + 10 : x + 13] = 0
    return page


@_query()
def page_notes(spark, sf_dir):
    """Notes read from drawn pages, one a supplier: held against what was drawn in the tests."""
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("image_id"))

    def draw(frames):
        for f in frames:
            f = f.assign(height=300, width=1200, data=[_drawn(1 + i % 8, int(i)).tobytes() for i in f["image_id"]], clef="treble")
            yield f[["image_id", "height", "width", "data", "clef"]]

    ids = ids.repartition(4 * spark.sparkContext.defaultParallelism, "image_id")  # few bytes, but a page of work each
    return detect.pages_read(ids.mapInPandas(draw, "image_id long, height int, width int, data binary, clef string"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange_cello(spark, sf_dir)
