"""The pipeline on a small table: each stage against plain Python."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quaver.llm import lines
from tests.llm.test_documents import brute_lines, groups, hash_of
from tests.llm.test_shingles import near, shingles

#: Columns whose names the operators use themselves.
CLASHING = ("h", "root", "key", "kept", "language", "size", "text_id", "id", "line_no", "s", "n", "of", "accepted", "doc")


@pytest.fixture(scope="module")
def docs(spark, sf):
    """Documents with null ids, one id with two texts, repeated rows, null and blank texts, and columns that clash."""
    rng = random.Random(2)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(120).collect()]
    own = [x for r in rows for x in (r[1] or "").split("\n")]
    made = [(None, "\n".join(rng.sample(own, 3)), "en", None, None) for _ in range(4)]
    made += [(rows[5][0], "\n".join(rng.sample(own, 4)), rows[5][2], "src1", 7), ((1 << 63) - 1, rows[9][1], rows[9][2], "src2", 1)]
    made += [rows[3], rows[3], made[0], (900_001, None, None, None, None), (900_002, "", None, "src1", 0), (900_003, " \t\r\n\r\n", "fr", "src1", 5)]
    rows += [(*r[:4], len(r[1]) if r[1] is not None else None) for r in made]
    rows = [(*r, *[f"{c}{i % 7}" for c in CLASHING]) for i, r in enumerate(rows)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, kind).repartition(3)


def place(r):
    return r.doc_id is None, r.doc_id or 0, hash_of(r.text or "")


def test_stages(spark, sf, docs, tmp_path):
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs.collect(), before.collect()
        if name != "packing":
            assert docs.columns == before.columns

    found, given = kept["language"]
    assert not Counter(found) - Counter(given)  # rows stay as they are
    assert all(r in found for r in given if r.text and len(r.text) > 100)

    found, given = kept["lines"]
    gone, _ = brute_lines([(place(r), r.text) for r in given])
    want = Counter()
    for r in given:
        text = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get(place(r), []))
        want[(*r[:1], text, *r[2:4], *r[5:])] += 1
    got = Counter((*r[:2], *r[2:4], *r[5:]) for r in found)
    assert sum((got - want).values()) <= 0.01 * len(given) and len(found) == len(given)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
    first = {}  # no line goes of which no copy stays
    for r in found:
        first.update((x, 1) for x in (r.text or "").split("\n"))
    left = [x for r in given for x in (r.text or "").split("\n") if x.strip(lines.BLANK) and x not in first]
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in first if x.strip(lines.BLANK)]
    for x in left:
        mine = {x[i : i + 8] for i in range(max(1, len(x) - 7))}
        assert max(len(mine & s) / len(mine | s) for s in sets) > 0.5

    found, given = kept["near_copies"]
    keys = sorted({place(r) for r in given})
    sets = {place(r): shingles(r.text) for r in given}
    root = groups([(a, b) for a in keys for b in keys if a < b and near(sets[a], sets[b])], keys)
    assert sorted(place(r) for r in found) == sorted(set(root.values()))
    assert not Counter(found) - Counter(given)

    found, given = kept["mix"]
    times = Counter(place(r) for r in found)
    assert set(times) <= {place(r) for r in given} and max(times.values()) <= 3
    assert set(found) <= set(given)

    found, given = kept["packing"]
    tokens = Counter()
    for r in found:
        tokens[r.doc_id, r.doc_tokens] += r.length
    rows = Counter(r.doc_id for r in given)
    assert Counter(i for (i, _), _ in tokens.items()).keys() == rows.keys()
    assert all(n % size == 0 for (_, size), n in tokens.items())
    assert sum(n // size for (_, size), n in tokens.items()) == len(given)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
