"""Page reading and signal operators against plain models and drawn pages."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from quaver.operators import detect, signal
from quaver.plans import catalogue


def test_kernels():
    rng = np.random.default_rng(4)
    g = rng.integers(0, 256, (40, 33)).astype(np.uint8)
    p = np.pad(g.astype(float), 7, mode="symmetric")
    assert np.allclose(detect.box_mean(g, 15), [[p[y : y + 15, x : x + 15].mean() for x in range(33)] for y in range(40)])
    ink = rng.random((30, 60)) < 0.7
    want = np.zeros_like(ink)
    for y in range(30):
        for x in range(56):
            if ink[y, x : x + 5].all():
                want[y, x : x + 5] = True
    assert (detect.opened(ink, 5) == want).all() and not detect.opened(ink, 61).any()
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    assert detect.filled(ring).sum() == 25 and set(detect.labelled(ring)[3]) == {0}
    ring[2, 4] = False
    assert detect.filled(ring).sum() == 15
    assert detect.otsu(np.full((4, 4), 9, np.uint8)) == 0
    assert detect.decode_pgm(b"P5 # c\n3 2 255\n\x00\x01\x02\x03\x04\x05").tolist() == [[0, 1, 2], [3, 4, 5]]


def test_staves():
    five = [100.0, 120.0, 140.0, 160.0, 180.0]
    assert detect.staves_of(five + [300 + 20 * k for k in range(5)], 20) == [five, [300 + 20 * k for k in range(5)]]
    assert detect.staves_of([100.0, 120.0, 160.0, 180.0], 20) == [five]
    assert detect.staves_of([120.0, 140.0, 160.0, 180.0], 20) == [[120.0, 140.0, 160.0, 180.0, 200.0]]  # top line missing: one line low
    assert detect.staves_of([100.0, 120.0, 300.0, 500.0], 20) == []


def test_pages():
    assert detect.read_page(np.full((200, 300), 255, np.uint8))["reason"] == detect.BLANK
    text = np.full((200, 300), 255, np.uint8)
    text[50:60, 20:30] = 0
    found = detect.read_page(text)
    assert not found["success"] and found["notes"] == [] and found["staff_count"] == 0
    for n, seed in ((4, 1), (7, 2), (8, 5)):
        found = detect.read_page(catalogue._drawn(n, seed))
        steps = [(seed * (i + 3)) % 9 for i in range(n)]
        assert found["notes"] == [f"{'CDEFGAB'[(30 + s) % 7]}{(30 + s) // 7}" for s in steps]
        assert found["staff_count"] == 1 and abs(found["spacing"] - 20) < 1


def test_rasters(spark, tmp_path):
    page = catalogue._drawn(5, 3)
    (tmp_path / "a.pgm").write_bytes(b"P5 1200 300 255\n" + page.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P6")
    from quaver.sources import files

    rows = detect.pages_read(files.rasters(spark, str(tmp_path))).orderBy(F.desc("success")).collect()
    assert rows[0].note_count == 5 and not rows[1].success and rows[1].reason.startswith("Could not open image")
    assert abs(rows[0].spacing - 30) < 1.5  # read from the enlarged image
    assert [m.token for m in rows[0].accepted] == rows[0].notes and all(m.score >= signal.ACCEPT for m in rows[0].accepted)
    found = detect.pages_read(files.rasters(spark, str(tmp_path)))
    assert detect.rejected_marks(found).count() == sum(len(r.rejected) for r in rows)
    told = {json.loads(r.report)["success"]: json.loads(r.report) for r in detect.report(found).collect()}
    assert told[True]["notes"] == rows[0].notes and told[False]["notes"] == []


def test_enlarged():
    """A windowed sinc keeps flat areas and smooth waves, and leaves wide images alone."""
    flat = np.full((40, 60), 77, np.uint8)
    assert (detect.enlarged(flat, 90) == 77).all() and detect.enlarged(flat, 90).shape == (60, 90)
    wave = lambda n, at: 128 + 100 * np.sin(at / n * 2 * np.pi * 3)
    small = np.tile(wave(200, np.arange(200) + 0.5), (30, 1)).round().astype(np.uint8)
    big = detect.enlarged(small, 500)
    assert np.abs(big[20, 20:-20].astype(float) - wave(500, np.arange(500) + 0.5)[20:-20]).max() < 3
    assert detect.enlarged(flat, 60) is flat


def test_labelled_by_flooding():
    rng = np.random.default_rng(9)
    for share in (0.3, 0.5, 0.6, 0.9):
        mask = rng.random((40, 50)) < share
        number, want = 0, np.zeros(mask.shape, int)
        for y, x in zip(*np.nonzero(mask), strict=True):
            if not want[y, x]:
                number += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 40 and 0 <= b < 50 and mask[a, b] and not want[a, b]:
                        want[a, b] = number
                        todo += [(a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)]
        got = np.full(mask.shape, -1)
        for y, a, b, k in zip(*detect.labelled(mask), strict=True):
            got[y, a:b] = k
        assert (got >= 0).tolist() == mask.tolist()
        assert len({(int(i), int(j)) for i, j in zip(got[mask], want[mask], strict=True)}) == number == len(set(got[mask].tolist()))


def test_suppressed(spark):
    rng = random.Random(6)
    marks = [(s, i, rng.random() * 6, rng.random() * 4, rng.choice([0.3, 0.5, 0.7])) for s in range(5) for i in range(30)]
    want = set()
    for s in range(5):
        kept = []
        for m in sorted((m for m in marks if m[0] == s), key=lambda m: (-m[4], m[1])):
            if not any(abs(m[2] - k[2]) < 0.7 and abs(m[3] - k[3]) < 0.8 for k in kept):
                kept.append(m)
        want |= {m[:2] for m in kept}
    df = spark.createDataFrame(marks, "staff int, id int, x double, y double, fill double")
    assert {(r.staff, r.id) for r in signal.suppressed(df, 0.7, 0.8).collect()} == want


def test_otsu_matches_kernel(spark):
    rng = np.random.default_rng(8)
    images = {i: rng.integers(0, 40 * (i + 1), 300) for i in range(5)} | {9: np.full(10, 77)}
    df = spark.createDataFrame([(i, int(v)) for i, x in images.items() for v in x], "image_id int, v int")
    found = {r.image_id: r.threshold for r in signal.otsu(signal.histogram(df)).collect()}
    assert found == {i: detect.otsu(x.astype(np.uint8).reshape(1, -1)) for i, x in images.items()}
