"""Operators on documents, held against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quaver.llm import components, lines, merkle, mixing, packing, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, size string"
WORDS = [a + b + c for a in ("ta", "ré", "lo", "mi") for b in ("n", "ß", "st", "") for c in ("ion", "er", "heit", "a")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = prose(rng, 60)
    texts += [texts[3]] * 8  # exact copies
    for i in range(12):  # near copies: one word differs
        words = texts[5].split(" ")
        words[(7 * i) % len(words)] = f"x{i}"
        texts.append(" ".join(words))
    texts += [prose(rng, 9) + " " + shared + " " + prose(rng, 11) for _ in range(9)]  # a shared passage
    texts += ["a " * 400, "ab" * 500, "", None, " \t\n", "one", "one two", "ONE TWO", prose(rng, 20_000), "é" * 120, "end <|endoftext|> here"]
    out = [(i, t, "en", f"s{i % 5}" if i % 11 else None, len(t or ""), i, "x") for i, t in enumerate(texts)]
    return out + [out[10], out[10]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500 + i) for i in range(50)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert found == groups(edges, nodes)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    prints = {r[0]: brute_print(r[1]) for r in rows}
    ids = sorted(prints)
    want = groups([(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3], ids)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in found} == {i: (prints[i], want[i]) for i in ids}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_hot_group():
    import numpy as np

    rng = np.random.default_rng(2)
    half = np.uint64(0xABCDEF01 << 32)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(32, 4, replace=False))) for _ in range(6000)]
    group = np.unique(np.array([half | f for f in flips], dtype="<u8"))
    links = simhash._links_of_group((1 << 40) | (32 << 32) | 0xABCDEF01, group)
    assert sum(len(b) for _, b in links) >= len(group) - 1
    small = group[:300]
    want = groups([(int(a), int(b)) for a in small for b in small if a < b and (int(a) ^ int(b)).bit_count() <= 3], [int(x) for x in small])
    got = groups([(int(a), int(x)) for a, b in simhash._spanning(small) for x in b], [int(x) for x in small])
    assert got == want


def brute_spans(rows, width=100):
    seen, out = {}, {}
    for i, text in sorted({(r[0], r[1] or "") for r in rows}):
        data, gone = text.encode(), bytearray(len(text.encode()))
        for p in range(len(data) - width + 1):
            if seen.setdefault(data[p : p + width], (i, p)) != (i, p):
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("parts", ["4", "37"])
def test_suffixes(spark, docs, rows, empty, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = suffixes.repeated_spans(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(rows)
    want = brute_spans(rows)
    for r in found:
        assert (r.n_bytes, sum(s["stop"] - s["start"] for s in r.spans), len(r.spans), r.kept_sha256) == want[r.doc_id], r.doc_id
    assert suffixes.repeated_spans(empty).count() == 0


@pytest.mark.parametrize("parts", ["4", "37"])
def test_suffixes_of_repeated_ids(spark, parts):
    """Null ids, and one id, with different texts: each text is a document of its own."""
    rng = random.Random(13)
    shared, hot = prose(rng, 40), prose(rng, 60)
    made = [(None, f"{prose(rng, n)} {shared} {prose(rng, 30)}") for n in (5, 5, 9, 40)] + [(None, prose(rng, 80)), (None, None)]
    made += [(4, shared + prose(rng, 50)), (4, prose(rng, 20)), (4, prose(rng, 50) + shared), (9, prose(rng, 90))]
    made += [(None, shared + "same start " + prose(rng, 30)), (None, shared + "same start, other end " + prose(rng, 30))]
    made += [(None if i % 2 else 11, prose(rng, 3) + hot) for i in range(40)]
    made += [(5, made[4][1]), made[0]]
    made += [((1 << 63) - 1, "ab"), ((1 << 63) - 1, prose(rng, 9) + hot), ((1 << 63) - 1, made[6][1])]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    last = 1 << 63
    names = {(last if i is None else i, hash_of(t or "")): t for i, t in made}
    spans = brute_spans([(k, names[k]) for k in sorted(names)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = suffixes.repeated_spans(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = Counter((i, *spans[last if i is None else i, hash_of(t or "")]) for i, t in made)
    assert Counter((r.doc_id, r.n_bytes, sum(s["stop"] - s["start"] for s in r.spans), len(r.spans), r.kept_sha256) for r in found) == want


def test_first_key_of_a_bucket_stays():
    """A first key whose copies fill whole batches is kept: the bucket before may end with it."""
    import pyarrow as pa

    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["key", "text_id", "pos"])

    hot, after = [(5, 70, 3)] * 10, [(6, 70, 9), (8, 71, 4), (9, 72, 1)]
    for parts in ([hot + after], [hot, after], [hot, hot, after], [hot, hot + after[:1], after[1:]]):
        found = [tuple(r.values()) for b in suffixes._candidate_batches(batch(*p) for p in parts) for r in b.to_pylist()]
        assert found == [(70, 3), (72, 1)]


def test_multikey_order():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (500, 24)).astype(np.uint8)
    x[100:200] = x[0]
    order, classes = suffixes.multikey_order(x)
    assert [bytes(r) for r in x[order]] == sorted(bytes(r) for r in x)
    assert [int(c) for c in classes] == [sorted({bytes(r) for r in x}).index(bytes(r)) for r in x[order]]
    assert all(a < b for a, b, c, d in zip(order, order[1:], classes, classes[1:], strict=False) if c == d)
    groups_ = np.repeat([0, 1, 2], [100, 300, 100])
    order, _ = suffixes.multikey_order(x, groups_)
    assert [bytes(r) for r in x[order]] == [y for a, b in ((0, 100), (100, 400), (400, 500)) for y in sorted(bytes(r) for r in x[a:b])]


def test_buckets_are_sorted_by_multikey_quicksort(monkeypatch):
    """Without it nothing comes out of a bucket."""
    monkeypatch.setattr(suffixes, "multikey_order", None)
    batch = next(iter(suffixes._context_batches(100, (suffixes.np.empty(0, "<i8"), suffixes.np.empty(0, "<i8")))([_context_row(b"x" * 300, [5, 150])])))
    with pytest.raises(TypeError):
        list(suffixes._array_batches(100)([batch.select(["key", "doc", "text_id", "pos", "lft", "context"])]))


def _context_row(data, spots):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([data], pa.binary()), pa.array([spots], pa.list_(pa.int32())), pa.array([7], pa.int64())], ["doc", "data", "spots", "text_id"])


def test_clashing_digests(spark, monkeypatch):
    """Texts that share their first digest are told apart, and lose what they should."""
    rng = random.Random(21)
    shared = prose(rng, 40)
    made = [(i, f"{prose(rng, 10)} {shared} {prose(rng, 10)}") for i in range(6)] + [(9, prose(rng, 50))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(suffixes.F, "xxhash64", lambda *c: F.lit(77).cast("long") if len(c) == 1 and isinstance(c[0], str) and c[0] == "data" else real(*c))
    found = {r.doc_id: (r.n_bytes, sum(s["stop"] - s["start"] for s in r.spans), len(r.spans), r.kept_sha256) for r in suffixes.repeated_spans(df).collect()}
    assert found == brute_spans(made)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_mixing(spark, docs, rows, empty):
    found = mixing.mixed(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0
    assert sum(sizes.values()) == sum(len((r[1] or "").encode().split()) for r in rows)
    want = brute_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():  # no document that may be taken once more brings its source nearer
        off = t - taken[s]
        assert not any(r.source == s and 0 < r.taken + r.size <= 3 * r.size and abs(off - r.size) < abs(off) - 1e-6 for r in found if r.size)
    assert sorted(map(str, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(str, found))
    assert mixing.mixed(empty).count() == 0
    copies = Counter(r.doc_id for r in mixing.mixture(docs).collect())
    once = Counter(r[0] for r in rows)
    assert copies == Counter({r.doc_id: once[r.doc_id] * r.taken // r.size for r in found if r.taken})


def test_targets_cap(spark):
    sizes = {"a": 1, "b": 50, "c": 400, "d": 3, "é": 90, "z": 0, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert all(found[s] == pytest.approx(want[s]) for s in sizes)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(packing.default_vocabulary())
    found = packing.packed(docs).collect()
    of, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in {(r[0], r[1]) for r in rows}:
        ids = made.encode(text or "", add_special_tokens=False).ids + [1]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        times = sum(r[0] == i for r in rows)
        assert sum(r.length for r in of[i]) == times * len(ids)
        for r in of[i]:
            assert r.doc_tokens == len(ids) and zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.packed(empty).count() == 0


def test_hilbert_key_is_a_walk():
    import numpy as np

    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    walk = points[np.argsort(packing.hilbert_key(points, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute_tree(text):
    """Sections as the tuples of their paragraphs."""
    return [tuple(re.findall(r"[^.!?]{1,40}[.!?]*|[.!?]+", s, re.S)) for s in text.split("\n")]


def brute_likeness(a, b):
    a, b = brute_tree(a), brute_tree(b)
    if a == b:
        return 1.0
    same = set(a) & set(b)
    one, two = ({p for s in set(t) - same for p in s} for t in (a, b))
    shared, both = sum(map(len, same)), sum(map(len, same)) * 2 + len(one) + len(two)
    return 2 * (shared + len(one & two)) / both if both else 0.0


def brute_edits(a, b):
    """Sections of a, and paragraphs in them, that are not those of the same number in b."""
    a, b = brute_tree(a), brute_tree(b)
    out = []
    for i, s in enumerate(a):
        other = b[i] if i < len(b) else None
        if s != other:
            out.append((i, [k for k, p in enumerate(s) if other is None or k >= len(other) or other[k] != p]))
    return out


def test_merkle(docs, rows, empty):
    found = merkle.fingerprinted(docs).collect()
    order = sorted((r[0], r[1] or "") for r in rows)
    assert len(found) == len(rows)
    want = Counter()
    for k, (i, text) in enumerate(order):
        cut, after = len(text) // 4, order[(k + 1) % len(order)][1]
        edited = text[: len(text) - cut] + after[:cut]
        near = round(brute_likeness(text, edited), 9), round(brute_likeness(text, after), 9)
        want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near, str(brute_edits(edited, text)))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), str([(e.section, e.paragraphs) for e in r.edits])) for r in found) == want
    by_text = defaultdict(set)
    for r in found:
        by_text[dict(order)[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
        assert (r.edits == []) == (r.fingerprint == r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert merkle.fingerprinted(empty).count() == 0


def test_merkle_single(spark):
    row = merkle.fingerprinted(spark.createDataFrame([(None, "abcdefgh")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def brute_lines(rows):
    places = [(i, n, x) for i, t in sorted({(r[0], r[1] or "") for r in rows}) for n, x in enumerate(t.split("\n")) if x.strip(lines.BLANK)]
    texts = sorted({x for _, _, x in places})
    sets = {x: shingles(x) for x in texts}
    links = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    of, first, gone = groups(links, texts), {}, defaultdict(list)
    for i, n, x in places:
        if first.setdefault(of[x], (i, n)) != (i, n):
            gone[i].append(n)
    return gone, len(links)


def test_lines(docs, rows, empty):
    want, links = brute_lines(rows)
    assert links
    found = lines.repeated_lines(docs).collect()
    assert len(found) == len(rows)
    right = sum(r.removed_lines == want.get(r.doc_id, []) for r in found)
    assert right >= 0.98 * len(rows)
    assert all(r.n_lines == sum(bool(x.strip(lines.BLANK)) for x in (dict((a[0], a[1]) for a in rows)[r.doc_id] or "").split("\n")) for r in found)
    assert lines.repeated_lines(empty).count() == 0
    cut = lines.without_repeated_lines(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    removed = {r.doc_id: r.removed_lines for r in found}
    for r in cut.collect():
        text = {a[0]: a[1] for a in rows}[r.doc_id]
        left = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in removed[r.doc_id])
        assert r.text == left


def test_lines_of_repeated_ids(spark):
    """Null ids, and one id, with different texts: each text is a document of its own."""
    rng = random.Random(12)
    own = [prose(rng, 25) for _ in range(8)]
    again = prose(rng, 25)
    made = [(1, again), (None, f"{again}\n{own[0]}\n{own[1]}"), (None, f"{own[2]}\n{own[3]}"), (None, own[4]), (None, f"{own[5]}\n{own[4]}")]
    made += [(7, f"{own[6]}\n{again}"), (7, f"{own[7]}\n{prose(rng, 25)}"), (7, f"{own[6]}\nlast"), (None, None)]
    made += [((1 << 63) - 1, own[4]), ((1 << 63) - 1, f"{own[5]}\n{own[5]}")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    order = sorted({(i is None, 0 if i is None else i, hash_of(t or ""), t or "") for i, t in made})
    seen, want = set(), {}
    for none, i, _, text in order:
        i = None if none else i
        parts = text.split("\n") if text else []
        want[(i, text)] = [n for n, x in enumerate(parts) if x in seen or seen.add(x)]
    assert sum(map(len, want.values())) == 7
    left = {(i, t): "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone) for (i, t), gone in want.items()}
    found = lines.repeated_lines(df).collect()
    assert Counter((r.doc_id, r.n_lines, tuple(r.removed_lines)) for r in found) == Counter((i, len((t or "").split("\n")) if t else 0, tuple(want[(i, t or "")])) for i, t in made)
    cut = lines.without_repeated_lines(df).collect()
    assert Counter((r.doc_id, r.text) for r in cut) == Counter((i, t and left[(i, t)]) for i, t in made)


def hash_of(text):
    """Spark's xxhash64() of a text."""
    found = xxhash.xxh64_intdigest(text.encode(), 42)
    return found - (1 << 64) if found >> 63 else found


def test_band_recall(spark):
    rng = random.Random(9)
    made = []
    for i in range(400):
        words = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(40)]
        other = list(words)
        other[rng.randint(0, 39)] = "changed"
        made += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = {(a[1], b[1]) for a, b in zip(made[::2], made[1::2], strict=True) if len(shingles(a[1]) & shingles(b[1])) >= 0.8 * len(shingles(a[1]) | shingles(b[1]))}
    df = spark.createDataFrame([(x,) for _, x in made], "line string").withColumn("h", F.xxhash64("line"))
    names = {r.h: r.line for r in df.collect()}
    found = {frozenset((names[r.a], names[r.b])) for r in lines.similar_links(df).collect()}
    assert len(want) > 300 and sum(frozenset(p) in found for p in want) >= 0.96 * len(want)


def test_similarity_counts_repeated_shingles_once(spark):
    """Lines that repeat themselves are compared as sets, right at the limit and beside it."""
    rng = random.Random(6)
    made = []
    for _ in range(60):
        line = "".join(rng.choice("abcd ") for _ in range(60)) * rng.randint(1, 4)
        at = rng.randint(0, len(line) - 1)
        made.append((line, line[:at] + "".join(rng.choice("xyz") for _ in range(rng.randint(1, 6))) + line[at:]))
    df = spark.createDataFrame([(x,) for x in sorted({x for p in made for x in p})], "line string").withColumn("h", F.xxhash64("line"))
    names = {r.line: r.h for r in df.collect()}
    pairs = spark.createDataFrame([(names[a], names[b]) for a, b in made], "a long, b long")
    texts = lines.texts_of(df, df.select("h"))
    assert {r.line: r.size for r in texts.collect()} == {x: max(1, len(x) - 7) for x in names}
    found = {(r.a, r.b) for r in lines.similar_pairs(pairs, texts).collect()}
    want = {(names[a], names[b]) for a, b in made if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))}
    assert found == want and 0 < len(want) < len(made)


def test_lines_are_not_copied_for_each_shingle(spark):
    """Lambdas take no line from a column (one that does copies it each time), and sketches are made where the line is."""
    df = spark.createDataFrame([("A line of some length",)], "line string").withColumn("h", F.xxhash64("line"))
    plan = lines.signatures(df)._jdf.queryExecution().analyzed().toString()
    inner = [x for x in re.findall(r"lambdafunction\(([^\n]*)", plan) if "substring(" in x]
    assert inner and not any(re.search(r"substring\(units#", x) for x in inner)
    texts = lines.texts_of(df, df.select("h"))
    assert texts.columns == ["h", "line", "size", "bits"] and len(texts.first().bits) == lines.SKETCH


def test_lines_of_white_space(spark):
    """Empty lines of texts whose lines end in carriage returns stay; so do other blank ones."""
    made = [(1, "One line that is here\r\n\r\nAnother line, further on\r\n\r\n"), (2, "One line that is here\r\n\r\n\t \n\r\n"), (None, None), (3, "")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    cut = {r.doc_id: r.text for r in lines.without_repeated_lines(df).collect()}
    assert cut == {1: made[0][1], 2: "\r\n\t \n\r\n", None: None, 3: ""}
    assert {r.doc_id: r.n_lines for r in lines.repeated_lines(df).collect()} == {1: 2, 2: 1, None: 0, 3: 0}


def test_signatures_of_lines_that_repeat_themselves(spark):
    """Long lines of few distinct shingles share bands with their likes, as all lines that are similar do."""
    rng = random.Random(3)
    made = []
    for _ in range(120):
        unit = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(9, 90)))
        made.append((unit * 40, unit * 41))
    df = spark.createDataFrame([(x,) for p in made for x in p], "line string").withColumn("h", F.xxhash64("line"))
    names = {r.h: r.line for r in df.collect()}
    found = {frozenset((names[r.a], names[r.b])) for r in lines.similar_links(df).collect()}
    assert sum(frozenset(p) in found for p in made) >= 0.98 * len(made)


@pytest.mark.parametrize("size", [12, 20, 45])
def test_recall_of_short_lines(spark, size):
    """Short lines a character apart at an end: a signature's minima depend on each other, so there are several."""
    rng = random.Random(size)
    made = []
    for _ in range(500):
        line = "".join(rng.choice("abcdefghij klmnop") for _ in range(size)).strip()
        made.append((line, line + "z"))
    want = [p for p in made if len(shingles(p[0]) & shingles(p[1])) >= 0.8 * len(shingles(p[0]) | shingles(p[1]))]
    df = spark.createDataFrame([(x,) for p in want for x in p], "line string").distinct().withColumn("h", F.xxhash64("line"))
    names = {r.h: r.line for r in df.collect()}
    found = {frozenset((names[r.a], names[r.b])) for r in lines.similar_links(df).collect()}
    assert len(want) > 300 and sum(frozenset(p) in found for p in want) >= 0.96 * len(want)


@pytest.mark.parametrize("whole", [lines.WHOLE_BAND, 0])
def test_large_bands(spark, monkeypatch, whole):
    """Lines of one large band: no pair between components is lost, whichever lines the band's heads are."""
    rng = random.Random(4)
    made = set()
    for family in range(6):
        words = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(30)]
        for _ in range(25):
            other = list(words)
            for _ in range(rng.randint(0, 5)):
                other[rng.randint(0, 29)] = str(rng.randint(0, 999))
            made.add(" ".join(other))
    made = sorted(made)
    links = [(a, b) for a in made for b in made if a < b and len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))]
    want = groups(links, made)
    df = spark.createDataFrame([(x,) for x in made], "line string").withColumn("h", F.xxhash64("line"))
    names = {r.h: r.line for r in df.collect()}
    texts = lines.texts_of(df, df.select("h"))
    left = texts.withColumn("root", F.col("h"))
    pairs = lines.similar_pairs(lines.prefix_pairs(left), texts).collect()
    assert {frozenset((names[r.a], names[r.b])) for r in pairs} == {frozenset(p) for p in links}
    order = df.orderBy("h").collect()
    places = [(1, r.h, len(made), order[i - 1].h if i else None, order[0].h) for i, r in enumerate(order)]
    places = spark.createDataFrame(places, "key long, h long, n long, back long, head long")
    roots = components.connected_components(lines.similar_pairs(lines.first_pairs(places), texts))
    left = lines.unsettled(places, roots)
    assert left.count() == len(made) and left.where(f"left > {whole}").count() == (len(made) if whole < len(made) else 0)
    monkeypatch.setattr(lines, "WHOLE_BAND", whole)
    late = lines.similar_pairs(lines.late_pairs(left, texts), texts)
    found = components.connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late))
    found = {names[r.node]: names[r.root] for r in found.collect()}
    classes = defaultdict(set)
    for x in made:
        classes[found.get(x, x)].add(x)
    expected = defaultdict(set)
    for x in made:
        expected[want[x]].add(x)
    assert {frozenset(c) for c in classes.values()} == {frozenset(c) for c in expected.values()}
    assert len(expected) > 6
