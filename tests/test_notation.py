"""The notation engine: functions, scores, MusicXML, gate, calibration, against plain Python and known cases."""

import json
import sys
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaver.functions import pitch as P
from quaver.operators import calibrate, gate, musicxml, reader, score
from quaver.sources import corpus, files, sinks, uploads


def column(spark, values, kind, expression):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cello_is_octave_shifts(spark):
    def plain(m):
        while m > 69 and m - 12 >= 36:
            m -= 12
        while m < 36 and m + 12 <= 76:
            m += 12
        return m

    values = list(range(-60, 160))
    assert column(spark, values, "int", P.cello) == [plain(m) for m in values]


def test_names(spark):
    assert column(spark, [0, 61, 63, 66, 68, 70, -1], "int", P.mixed_name) == ["C-1", "C#4", "Eb4", "F#4", "Ab4", "Bb4", "B-2"]
    assert column(spark, [61, 63, 70, 72], "int", P.sharp_name) == ["C#4", "D#4", "A#4", "C5"]


def test_positions(spark):
    df = spark.createDataFrame([("E", 4, "treble"), ("F", 4, "treble"), ("F", 5, "treble"), ("G", 5, "treble"), ("A", 5, "treble"), ("D", 4, "treble"), ("C", 4, "treble"), ("C", 4, "bass"), ("F", 3, "alto"), ("C", 4, "tenor")], "s string, o int, c string")
    rows = df.select(P.staff_position(F.col("s"), F.col("o"), F.col("c")).alias("a"), P.staff_position_text(F.col("s"), F.col("o"), F.col("c")).alias("b")).collect()
    assert [r.a for r in rows] == ["line 1", "space 1", "line 5", "ledger space above", "1 ledger line above", "ledger space below", "1 ledger line below", "1 ledger line above", "line 1", None]
    assert rows[0].b == "line 1 of the staff" and rows[6].b == "1 ledger line(s) below the staff"


def test_tokens(spark):
    text = "Bb3 BB3 b3 C##4 F#-1 Bbb4 C4-5 H2"
    assert column(spark, [text], "string", P.tokens_in) == [["Bb3", "b3", "F#-1", "C4"]]
    assert column(spark, ["g5 G5 g5 c4"], "string", P.normal_tokens) == [["G5", "C4"]]
    assert column(spark, ["C4", " Bb3\n", "c4", "C##4", "", None], "string", P.strict_midi) == [60, 58, None, None, None, None]


def test_step_token_inverts(spark):
    df = spark.range(-30, 40).select(F.col("id").alias("s"), P.step_token(F.col("id"), F.lit("bass")).alias("t"))
    n = P.token_parts(F.col("t"))
    assert df.where(n["octave"] * 7 + P.diatonic(n["step"]) - P.bottom_index(F.lit("bass")) != F.col("s")).count() == 0


def test_command_line(spark):
    lines = spark.createDataFrame([(1, " E5 F5\tG5 A5 "), (2, "AB3 x Q4 C C# D4junk Eb+5"), (3, "")], "line_id int, line string")
    rows = score.arranged(lines).orderBy("line_id", "seq").collect()
    assert [r.output for r in rows if r.line_id == 1] == ["E4", "F4", "G4", "A4"]
    two = [r for r in rows if r.line_id == 2]
    assert [r.midi for r in two] == [56, None, None, None, None, 62, 75]
    assert [r.error for r in two] == [None, "Note is too short: x", "Invalid note letter.", "Note is too short: C", "Missing octave in note: C#", None, None]
    moved = score.translated(lines.where("line_id = 1"), "treble", "bass").orderBy("seq").first()
    assert (moved.pitch, moved.from_position, moved.to_position) == ("E5", "space 4 of the staff", "ledger space above the staff")


def test_requests(spark):
    bodies = ['{"notes": " C4 E4 ", "to_clef": ""}', "{}", "nonsense", '{"to_clef": "tenor"}', '{"notes": "C6", "to_clef": "treble", "title": "T"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "score_id int, body string")
    rows = score.requests(df).orderBy("score_id").collect()
    assert [r.error for r in rows] == [None, None, "Expected JSON body", "Unknown clef", None]
    assert (rows[0].notes_text, rows[0].from_clef, rows[0].to_clef) == ("C4 E4", "treble", "bass")
    made = score.adapted(score.requests(df).where("error is null")).orderBy("score_id").collect()
    assert made[0].tokens == ["C4", "E4"] and made[1].note_count == 0 and made[2].tokens == ["C6"]
    assert made[1].musicxml.count("<rest />") == 4 and "<measure number=\"2\">" not in made[1].musicxml


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(24, 100), max_size=13))
def test_round_trip(spark, midis):
    text = " ".join(P.MIXED_NAMES[m % 12] + str(m // 12 - 1) for m in midis)
    df = spark.createDataFrame([(1, text, "treble", "alto", "a < b & c")], "score_id int, notes_text string, from_clef string, to_clef string, title string")
    made = score.adapted(df).select(F.col("score_id").alias("read_id"), "musicxml")
    assert [r.token for r in musicxml.tokens(made).orderBy("seq").collect()] == text.split()
    assert musicxml.key_fifths(made).first().key_fifths == -1
    sums = musicxml.coherence(musicxml.measure_rows(made)).first()
    assert (sums.bad, sums.total) == (0, max(1, -(-len(midis) // 4)))


XML = """<score-partwise xmlns="urn:x"><part id="P1"><measure><attributes><divisions>1</divisions><key><fifths>2</fifths></key><time><beats>4</beats><beat-type>4</beat-type></time></attributes>
{notes}</measure><measure>{notes}</measure></part></score-partwise>"""
NOTE = "<note>{x}<pitch><step>{s}</step>{a}<octave>{o}</octave></pitch><duration>{d}</duration></note>"


def test_reading(spark):
    notes = NOTE.format(x="", s="A", a="<alter>-1</alter>", o=4, d=1) + NOTE.format(x="<chord/>", s="C", a="", o=5, d=1) + "<note><rest/><duration>1</duration></note>"
    notes += NOTE.format(x="", s="B", a="<alter>x</alter>", o=3, d=1) + NOTE.format(x="", s="C", a="<alter>2</alter>", o=4, d=1) + NOTE.format(x="", s="", a="", o=4, d=0)
    df = spark.createDataFrame([(1, XML.format(notes=notes)), (2, "<score-partwise><part>"), (3, ""), (4, None)], "read_id int, musicxml string")
    assert [r.token for r in musicxml.tokens(df).orderBy("read_id", "seq").collect()] == ["Ab4", "B3", "C##4"] * 2
    assert {r.read_id: r.key_fifths for r in musicxml.key_fifths(df).collect()} == {1: 2, 2: None, 3: None, 4: None}
    assert [tuple(r) for r in musicxml.coherence(musicxml.measure_rows(df)).collect()] == [(1, 0, 2)]


def test_gate(spark):
    good = ["Ab4", "C5", "Eb5", "Db5", "Eb5"]
    cases = [
        ("coherent", good, 0, 2, 5, 0.88, 0), ("few", ["C5"], 0, 0, None, None, None), ("range", ["C5", "C12", "C5"], 0, 0, None, None, None),
        ("erratic", ["C2", "C7", "C2", "C7"], 0, 0, None, None, None), ("bars", good, 2, 2, None, None, None), ("weak", good, 0, 2, 5, 0.31, 1), ("empty", [], None, None, None, None, None),
        ("double", ["C##4", "D4"], 0, 0, None, None, None),
    ]
    df = spark.createDataFrame([(c[0], *c[1:6], c[5], c[6]) for c in cases], "read_id string, tokens array<string>, bad int, total int, head_count int, mean_ctx double, min_ctx double, weak int")
    rows = {r.read_id: r for r in gate.read_results(gate.assessed(df)).collect()}
    failed = {k: [c.check for c in r.decision_path if not c.ok] for k, r in rows.items()}
    assert failed == {"coherent": [], "few": ["note_count"], "range": ["pitch_range", "erratic_leaps"], "erratic": ["erratic_leaps"], "bars": ["measure_arithmetic"], "weak": ["engine_grades"], "empty": ["note_count", "pitch_range"], "double": ["pitch_range"]}
    assert rows["weak"].reason.startswith("engine_grades [engine]: mean ctx-grade 0.31 (min 0.31), 20% below 0.35; need mean ≥0.55")
    assert rows["coherent"].success and rows["coherent"].notes == good and rows["weak"].notes == [] and rows["few"].reason == "note_count [tokens]: 1 note(s)"
    assert all(len(r.decision_path) == 5 for r in rows.values())


def test_thresholds(spark):
    kind = "priority int, path string, ctx_mean_min string, measure_bad_fraction string"
    found = gate.thresholds(spark.createDataFrame([(1, "a", "-0.001", "0.5"), (2, "b", "x", "0.5"), (3, "c", "0.708", "1.01"), (4, "d", "0.1", "0")], kind)).first()
    assert tuple(found) == (0.708, 1.01, "calibrated (c)")
    assert tuple(gate.thresholds(spark.createDataFrame([], kind)).first()) == (0.55, 0.5, "fallback (hand-set guesses)")


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.one_of(st.none(), st.integers(-20, 300)), max_size=8)] * 2), min_size=1, max_size=20))
def test_agreement(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, truth array<int>, read array<int>")
    for r in calibrate.scored(df).collect():
        want = 1.0 if not r.truth and not r.read else 0.0 if not r.truth or not r.read else 1 - plain_distance(r.truth, r.read) / max(len(r.truth), len(r.read))
        assert r.agreement == pytest.approx(want) and r.should_accept == (r.agreement >= 0.85)


def test_calibration_on_known_shares(spark):
    rows = [(0.79, 0.0, True)] * 14 + [(0.709, 0.333, True)] * 3 + [(0.70, 0.0, False), (0.69, 1.0, False), (0.5, 0.0, False), (0.8, 0.667, False)]
    df = spark.createDataFrame(rows, "mean_ctx double, bad_frac double, should_accept boolean")
    found = calibrate.calibrated(df).first()
    assert tuple(found) == (0.708, 0.5, 21, "17/17", "0/4")
    counts = calibrate.confusion(df, calibrate.grid(df)).collect()
    for r in counts:
        taken = [g for c, b, g in rows if c >= r.t and b <= r.m]
        assert (r.tp, r.fp, r.fn) == (sum(taken), len(taken) - sum(taken), 17 - sum(taken))


def test_confusion_near_zero(spark):
    """Thresholds under mean_ctx 0 and 0.001 are below 0 and equal to it."""
    rows = [(c, b, c != 0.3) for c in (0.0, 0.001, 0.002, 0.3, 0.5) for b in (0.0, 0.5)]
    df = spark.createDataFrame(rows, "mean_ctx double, bad_frac double, should_accept boolean")
    counts = calibrate.confusion(df, calibrate.grid(df)).collect()
    assert len(counts) == 7 * 5
    for r in counts:
        taken = [g for c, b, g in rows if c >= r.t and b <= r.m]
        assert (r.tp, r.fp, r.fn) == (sum(taken), len(taken) - sum(taken), 8 - sum(taken))


def test_corpus(spark):
    rows = corpus.labelled(spark).collect()
    assert len(rows) == 56 and all(None not in r.gt_midi for r in rows)
    assert min(m for r in rows for m in r.gt_midi) == 60 and max(m for r in rows for m in r.gt_midi) == 77


def test_reader(spark):
    kind = "upload_id int, engine_notes array<string>, heuristic_notes array<string>, staff_count int, raw_text string"
    df = spark.createDataFrame([(1, ["C4"], ["D4"], 1, "E4"), (2, None, ["D4"], 1, "E4"), (3, [], [], 0, "e4 E4"), (4, [], [], 2, "E4"), (5, None, None, None, None)], kind)
    rows = {r.upload_id: (r.detection_mode, r.notes, r.fallback) for r in reader.chosen(df).collect()}
    assert rows == {1: ("engine-omr", ["C4"], False), 2: ("heuristic-detection", ["D4"], True), 3: ("text-ocr-fallback", ["E4"], True), 4: ("none", [], False), 5: ("none", [], False)}
    assert [r.upload_id for r in reader.unread(df, df.select("upload_id", F.col("engine_notes").alias("notes"))).orderBy("upload_id").collect()] == [2, 3, 4, 5]


def test_files(spark, tmp_path):
    (tmp_path / "s/a").mkdir(parents=True)
    (tmp_path / "s/b").mkdir()
    with zipfile.ZipFile(tmp_path / "s/a/z.mxl", "w") as z:
        z.writestr("META-INF/container.xml", "<no/>")
        z.writestr("score.xml", "<yes/>")
    (tmp_path / "s/a/a.xml").write_text("<later/>")
    (tmp_path / "s/b/bad.mxl").write_bytes(b"no zip")
    (tmp_path / "s/b/b.musicxml").write_text("<plain/>")
    assert {r.read_id: r.musicxml for r in files.scores(spark, str(tmp_path / "s")).collect()} == {"a": "<yes/>", "b": "<plain/>"}
    with zipfile.ZipFile(tmp_path / "g.omr", "w") as z:
        z.writestr("sheet#1/sheet#1.xml", '<head-chord grade="0.1"/><head ctx-grade="0.9" grade="0.8" shape="NOTEHEAD_BLACK" pitch="-3"/><head grade="0.3"></head><head shape="X"/>')
    (tmp_path / "h.omr").write_bytes(b"x")
    got = sorted(tuple(r) for r in files.heads(spark, str(tmp_path)).collect())
    assert got == [("g", "", 0.3, 0.3, None), ("g", "NOTEHEAD_BLACK", 0.8, 0.9, -3)]
    (tmp_path / "p.json").write_text(json.dumps({"CTX_MEAN_MIN": 0.6, "MEASURE_BAD_FRACTION": 0.25}, indent=1))
    rows = files.gate_candidates(spark, [str(tmp_path / "none.json"), str(tmp_path / "p.json")])
    assert tuple(gate.thresholds(rows).first())[:2] == (0.6, 0.25)
    (tmp_path / "d.jsonl").write_text('{"image": "i", "agreement": 0.5, "features": null}\n\n{"image": "j", "features": {"mean_ctx": 0.7}}\n')
    assert [r.features and r.features.mean_ctx for r in files.dataset(spark, str(tmp_path / "d.jsonl")).orderBy("image").collect()] == [None, 0.7]


def test_dataset_of_reads(spark, tmp_path):
    """From a manifest and reads of its images to dataset rows, and from those to gate parameters."""
    truth = corpus.labelled(spark).where("piece in ('cmajor', 'triad')").withColumn("image", F.concat_ws("/", "piece", "quality"))
    manifest = truth.select("image", "piece", "quality", "gt_tokens", "gt_midi")
    sinks.write_rows(manifest, str(tmp_path / "manifest"))
    manifest = spark.read.schema(files.MANIFEST).json(str(tmp_path / "manifest"))
    made = [("cmajor/clean", "C4 D4 E4 F4 G4 A4 B4 C5", 1, 4, 8, 0.79, 0.7, 1), ("cmajor/blur", "C4 D4 E4 F4 G4 A4 B4 C9", 0, 4, 8, 0.7, 0.3, 3), ("triad/clean", "C4", 0, 0, None, None, None, None)]
    made = spark.createDataFrame([(i, t.split(" "), *r, "") for i, t, *r in made] + [("triad/blur", None, *[None] * 6, "x" * 90)], "image string, tokens array<string>, bad int, total int, head_count int, mean_ctx double, min_ctx double, weak int, note string")
    sinks.write_rows(calibrate.collected(manifest, made), str(tmp_path / "dataset"))
    rows = {r.image: r for r in files.dataset(spark, str(tmp_path / "dataset")).collect()}
    assert len(rows) == 14 and sum(r.audiveris_ok for r in rows.values()) == 3
    one, two, three, none = (rows[k] for k in ("cmajor/clean", "cmajor/blur", "triad/clean", "triad/blur"))
    assert (one.agreement, one.should_accept, one.features.measures_bad_frac, one.features.weak_frac, one.features.wild_frac) == (1.0, True, 0.25, 0.125, 0.0)
    assert (two.agreement, two.should_accept, two.features.wild_frac) == (0.875, True, round(1 / 7, 3))
    assert (three.agreement, three.features.mean_ctx, three.features.head_count) == (round(1 / 7, 3), None, None)
    assert (none.agreement, none.features, none.note, none.notes) == (0.0, None, "x" * 80, [])
    graded = calibrate.graded(files.dataset(spark, str(tmp_path / "dataset")))
    assert sorted(r.mean_ctx for r in graded.collect()) == [0.7, 0.79]  # reads without grades do not calibrate
    sinks.write_params(calibrate.calibrated(graded), str(tmp_path / "params"))
    found = gate.thresholds(files.gate_candidates(spark, [str(tmp_path / "none"), str(tmp_path / "params")])).first()
    assert found.ctx_mean_min == 0.0 and found.measure_bad_fraction == 0.25 and found.source.startswith("calibrated")


def test_uploads(spark):
    rows = [("a.PNG", b"x"), ("b", b"x"), ("c.exe", b"x"), ("d.pdf", b""), ("e.pdf", b"12345"), (None, None)]
    found = [r.error for r in uploads.checked(spark.createDataFrame(rows, "name string, content binary"), most=4).collect()]
    assert found[0] is None and found[1].startswith("Unsupported file type (none); expected one of .bmp, ") and found[2].startswith("Unsupported file type .exe;")
    assert found[3] == found[5] == uploads.NO_FILE and found[4] == "Upload too large (max 0 MB)"


def test_reader_program(spark, tmp_path):
    """A read is good if a score is there, whatever the program returns; a program that hangs is stopped."""
    program = tmp_path / "reader.py"
    program.write_text(
        "import sys, time, pathlib\n"
        "data = pathlib.Path(sys.argv[1]).read_text()\n"
        "if data == 'hang': time.sleep(60)\n"
        "if data != 'none': pathlib.Path(sys.argv[2], 'made.xml').write_text('<' + data + '/>')\n"
        "sys.exit(data if data == 'none' else 3)\n"
    )
    df = spark.createDataFrame([(k, f"{k}.png", k.encode()) for k in ("good", "none", "hang")], "image string, name string, content binary").repartition(3)
    command = [sys.executable, str(program)]
    rows = {r.image: r for r in uploads.read_by(df, command, timeout=5).collect()}
    assert rows["good"].musicxml == "<good/>" and rows["good"].note is None and rows["good"].heads == []
    assert rows["none"].musicxml is None and rows["none"].note == "none" and "5 s" in rows["hang"].note
    assert uploads.available(command) and not uploads.available(["no-such-program"])


def test_clefs(spark):
    assert column(spark, ["bass", "alto", None], "string", P.parsed_clef) == ["bass", "alto", None]
    with pytest.raises(Exception, match="Unknown clef: tenor"):
        column(spark, ["tenor"], "string", P.parsed_clef)
    assert column(spark, ["bass", "tenor"], "string", P.clef_or_treble) == ["bass", "treble"]
    assert column(spark, ["bass", "alto"], "string", P.part_name) == ["Cello", "Converted Part"]
    assert json.loads(column(spark, ["x"], "string", lambda x: sinks.answer(x.alias("a"), F.lit(None).cast("string").alias("b")))[0]) == {"a": "x", "b": None}


def test_leaps_of_long_reads(spark):
    """Counting leaps takes time in proportion to the notes."""
    import time

    tokens = ["C4", "C7"] * 4000
    began = time.perf_counter()
    row = spark.createDataFrame([(tokens,)], "t array<string>").select(gate.leap_counts(gate.midi_array(F.col("t"))).alias("c")).first()
    assert (row.c.leaps, row.c.wide) == (7999, 7999) and time.perf_counter() - began < 15
