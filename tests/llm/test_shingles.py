"""Near copies of the pipeline, held against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from quaver.llm import simhash
from tests.llm.test_documents import WORDS, groups


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def test_near_copies(spark, sf):
    rng = random.Random(8)
    prose = lambda n: [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)]
    texts, passage = [], prose(40)
    for size in (12, 30, 60, 150, 400, 1500):  # copies of all similarities about 0.8
        base = prose(size)
        texts.append(" ".join(base))
        for _ in range(12):
            other = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                other[rng.randrange(size)] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(other))
    base = prose(80)
    for i in range(60):  # a chain, and a large group about the limit
        base[i] = f"y{i}"
        texts.append(" ".join(base))
    texts += [" ".join(prose(30) + passage + prose(30)) for _ in range(30)]
    texts += [texts[3], texts[3].upper(), "", None, " \n", "one", "One", "one two", "a b c d", "a b c d e"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([*rows, (None, texts[0]), (None, "no other")], "doc_id long, text string").repartition(3)
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and near(sets[a], sets[b])]
    want = sorted(set(groups(links, ids).values()))
    kept = corpus_pipeline.one_of_each(spark, docs, sf)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == want
    assert [r.text for r in kept if r.doc_id is None] == ["no other"]
    far = [(a, b) for a, b in links if (simhash.simhash(texts[a]) ^ simhash.simhash(texts[b])).bit_count() > 3]
    assert len(far) > 100  # these the fingerprints of op2 do not link


def test_sketches():
    """Sketches never differ by more than the sets do."""
    import numpy as np

    from quaver.llm import shingles as operator

    rng = np.random.default_rng(6)
    for size in (1, 20, 300, 5000):
        one = np.unique(rng.integers(0, 1 << 63, size, dtype="<u8"))
        for share in (0, 0.1, 0.5, 1):
            two = np.unique(np.concatenate([one[rng.random(len(one)) >= share], rng.integers(0, 1 << 63, int(size * share), dtype="<u8")]))
            bits = int(np.bitwise_count((operator.sketch(one) ^ operator.sketch(two)).view("<u8")).sum())
            assert bits <= len(np.setxor1d(one, two)) and (share or not bits)


def test_pairs_of_long_texts(spark, sf, monkeypatch):
    """Long texts that share passages are told apart before whole sets are sent; similar ones of unlike length are found."""
    from quaver.llm import shingles as operator

    rng = random.Random(9)
    prose = lambda n: [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)]
    passages = [prose(200) for _ in range(60)]
    texts = [" ".join([*prose(2500), *passages[i], *prose(500), *passages[i - 1]]) for i in range(60)]
    for size in (960, 1900, 2040, 3900):  # sketches of one length and of two
        base = prose(size)
        texts += [" ".join(base[: size - cut] + prose(more)) for cut, more in ((0, 0), (0, size // 10), (size // 20, 0), (size // 12, size // 12), (size // 6, size // 6), (0, size // 4 + 8))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if near(sets[a], sets[b])]
    counts, write = {}, operator.materialize

    def counted(df, name):
        found = write(df, name)
        counts[name] = counts.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(operator, "materialize", counted)
    kept = corpus_pipeline.one_of_each(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups(links, range(len(sets))).values()))
    assert len(links) >= 20 and counts["shingle-close"] < 2 * len(links)


def test_late_pairs(spark):
    """Of sets with prefixes that overlap by chance few are pairs; of those similar none is lost."""
    import numpy as np

    from quaver.llm import shingles as operator

    rng = np.random.default_rng(3)
    common, sets = rng.integers(0, 1 << 50, 30, dtype="<u8"), []
    for i in range(40):
        own = rng.integers(0, 1 << 62, int(rng.integers(60, 200)), dtype="<u8")
        sets.append(np.unique(np.concatenate([own, rng.choice(common, 4)])))
        for share in (0.05, 0.1, 0.15, 0.3)[: i % 5]:
            drawn = rng.random(len(own)) >= share
            sets.append(np.unique(np.concatenate([sets[-1][: len(sets[-1]) // 2], own[drawn], rng.integers(0, 1 << 62, i % 20, dtype="<u8")])))
    rows = [(int(x), i, len(s), k, 4) for i, s in enumerate(sets) for k, x in enumerate(s[: len(s) - (4 * len(s) + 4) // 5 + 1])]
    shared = spark.createDataFrame(rows, "s long, h long, size int, place int, n long")
    found = {(r.a, r.b) for r in operator._late_pairs(shared, spark.createDataFrame([], "node long, root long")).collect()}
    both = [(a, b, np.intersect1d(sets[a], sets[b]).size) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    similar = {(a, b) for a, b, n in both if 9 * n >= 4 * (len(sets[a]) + len(sets[b]))}
    met = {(a, b) for a, b, n in both if n}
    assert similar and similar <= found and len(found - similar) < 0.2 * len(met - similar)


def test_fingerprints_propose(spark, sf, monkeypatch):
    """Without the prefix filter, copies whose fingerprints link are found, and no others."""
    from quaver.llm import shingles as operator

    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(operator, "_near_pairs", lambda shared: none)
    monkeypatch.setattr(operator, "_late_pairs", lambda shared, roots: none)
    rng = random.Random(10)
    prose = lambda n: [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)]
    texts = ["", "one", "one two"]
    for size in (12, 100, 400, 900):
        for _ in range(6):
            base = prose(size)
            texts += [" ".join(base), " ".join(["new", *base[1:]]), " ".join([*base[: size // 2], *prose(size // 2)])]
    texts.append(" ".join(texts[-1].split() * 2))  # another text with much the same shingles
    prints = [simhash.simhash(t, 5) for t in texts]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (prints[a] ^ prints[b]).bit_count() <= 3 and near(sets[a], sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.one_of_each(spark, docs, sf).collect()
    assert len(links) > 5 and sorted(r.doc_id for r in kept) == sorted(set(groups(links, range(len(texts))).values()))
