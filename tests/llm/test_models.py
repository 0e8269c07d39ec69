"""Models: held-out accuracy, exact scores, rules."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.llm import ann, language, toxicity, urls
from tests.llm.test_documents import hash_of


def test_toxicity(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdflmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            text.insert(rng.randint(0, len(text)), "grozz" + rng.choice(["", "en", "ly", "it"]))
        rows.append((i, " ".join(text).capitalize(), 1))
        labels.append((i, toxic))
    labels += [(None, 1), (5, None)]
    rows += [(10_000, "", 0), (10_001, None, 0), (10_002, "grozzable " * 30, 0), (None, "x", 0), (10_003, "la " * 30_000, 0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.scored(docs, toxicity.fit(*toxicity.sample(docs, labels))).collect()
    assert len(found) == len(rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in found if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    of, text = {r.doc_id: r for r in found}, {r[0]: r[1] for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert of[10_002].predicted == 1 and of[10_000].predicted == 0 and of[10_000].score == of[10_001].score
    assert all(text[r.doc_id][s.start : s.stop].lower().startswith("grozz") for r in found for s in r.spans if r.doc_id in truth)
    none = toxicity.scored(docs, toxicity.fit(*toxicity.sample(docs, labels.where("false"))))
    assert none.count() == len(rows) and toxicity.scored(docs.where("false"), toxicity.Scorer(None, np.zeros(4))).count() == 0


def test_short_texts_are_learned_from():
    """Comments shorter than a training window teach the field as well."""
    rng = random.Random(5)
    words, foul = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)], ["grukk", "snarv", "blorp"]
    made = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(3, 9))]
        if i % 4 == 0:
            text.insert(rng.randint(0, len(text)), rng.choice(foul))
        made.append((" ".join(text), int(i % 4 == 0)))
    scorer = toxicity.fit([t for t, _ in made[:300]], np.array([y for _, y in made[:300]]), 0.25)
    scores, _ = scorer.documents([t for t, _ in made[300:]])
    assert sum((s >= toxicity.THRESHOLD) == bool(y) for s, (_, y) in zip(scores, made[300:], strict=True)) >= 98


def test_masked_windows_are_as_unmasked_ones():
    """What lies past a window's length does not change the fit."""
    rng = np.random.default_rng(6)
    words, states = rng.integers(0, 50, (40, 6, 5)), rng.integers(0, 2, (40, 6))
    lengths = np.full(40, 4)
    one = toxicity.fit_field(words[:, :4], states[:, :4])
    two = toxicity.fit_field(words, states, lengths)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.moves, two.moves) and np.allclose(one.head, two.head)


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(1), 0.0, rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([3, 1, 6])
    scores = rng.normal(size=10)
    starts = np.array([0, 3, 4])
    got = field.marginals(scores, starts, lengths)
    for a, n in zip(starts, lengths, strict=True):
        s, total, mass = scores[a : a + n], 0.0, np.zeros(n)
        for path in range(1 << n):
            bits = [path >> i & 1 for i in range(n)]
            w = math.exp(field.head[bits[0]] + sum(s[i] for i in range(n) if bits[i]) + sum(field.moves[x][y] for x, y in zip(bits, bits[1:], strict=False)))
            total += w
            mass += w * np.array(bits)
        assert np.allclose(got[a : a + n], mass / total)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0, None] + [0.0] * 14, 0), (None, x[0].tolist(), 0), (5080, [1.0, 2.0], 0), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = ann.nearest(df).collect()
    y = x.astype(np.float64)
    lists = {}
    for r in found:
        lists.setdefault(r.query_id, []).append(r)
    assert sorted(lists) == list(range(0, 3000, 20))
    hits = 0
    for q, own in lists.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        score = y @ y[q]
        assert all(r.score == pytest.approx(score[r.vec_id], rel=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        score[100:400] = score[100]
        want = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
        hits += len(set(want) & {r.vec_id for r in own})
    assert hits >= 0.9 * 20 * len(lists)
    assert ann.nearest(df.where("vec_id < 0")).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2, 20)")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(q, k) for q in (0, 20) for k in (1, 2, 3)]


def test_language(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    found = language.documents_identified(docs.where("doc_id % 2 = 1"), model).select("lang", "language.text_lang", "language.accepted").collect()
    assert sum(r.lang == r.text_lang for r in found) >= 0.97 * len(found) and all(r.accepted for r in found)
    told = language.pages_identified(pages, model).select("url", "language.*")
    assert told.where(~F.col("url").contains(F.concat(F.lit("/"), "lang", F.lit("/")))).count() <= 0.03 * pages.count()
    odd = [(1, None, None, None, "k"), (2, "", "de", "src1", "k"), (3, "0 1 2 # 9 8 7 %% " * 40, "en", "src1", "k"), (4, "x", "en", "new", "k")]
    odd = spark.createDataFrame(odd + odd[:1], "doc_id long, text string, lang string, source string, host string")
    rows = {r.doc_id: r.language for r in language.documents_identified(odd, model).collect()}
    assert rows[2].lang == "de" and rows[3].lang == "und" and not rows[3].accepted and rows[1].lang in model.languages
    assert language.documents_identified(odd, language.fit(docs.where("false"))).where("language.accepted").count() == 0
    assert language.documents_identified(odd.where("false"), model).count() == 0


def test_posterior_by_hand(spark):
    """Text, declaration and priors of host, domain and suffix against plain Python, for all rows."""
    rng = random.Random(4)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40)] for x, letters in (("aa", "abcde"), ("bb", "bcdef"), ("cc", "defgh"))}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    train = spark.createDataFrame([(i, say(x, 30), x) for i, x in enumerate(list(words) * 20)], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.languages == ["aa", "bb", "cc"]
    hosts = ["a.x.net", "b.x.net", "x.net", "a.y.org", "y.org", "", None]
    rows = [(i, rng.choice([say(rng.choice(list(words)), rng.choice([0, 1, 3, 20])), None]), rng.choice(["aa", "bb", "cc", "zz", None]), rng.choice(hosts)) for i in range(80)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "id long, text string, said string, host string")
    found = language.identified(df, model, "text", F.col("said"), F.col("host"), False).collect()
    soft = lambda v: (lambda e: e / e.sum())(np.exp(np.array(v) - max(v)))
    likes, alone = {}, {}
    for i, text, said, host in rows:
        *mean, grams = model.evidence((text or "").encode())
        likes[i] = np.array(mean) * min(grams, language.EVIDENCE)
        alone[i] = soft(likes[i])
    table = np.full((3, 4), 1.0)
    table[range(3), range(3)] += language.DECLARED_ROWS
    for i, _, said, _ in rows:
        table[:, model.languages.index(said) if said in words else 3] += alone[i]
    table = np.log(table / table.sum(axis=1, keepdims=True))
    level = {"suffix": lambda h: h.split(".")[-1], "domain": lambda h: ".".join(h.split(".")[-2:]), "host": lambda h: h}
    for r, (i, text, said, host) in zip(sorted(found, key=lambda r: r.id), sorted(rows, key=lambda r: r[0]), strict=True):
        prior = (sum(alone[x[0]] for x in rows) + 1.0) / (len(rows) + 3)
        for name in ("suffix", "domain", "host"):
            own = [alone[x[0]] for x in rows if level[name](x[3] or "") == level[name](host or "")]
            prior = (sum(own) + language.PRIOR_ROWS * prior) / (len(own) + language.PRIOR_ROWS)
        p = soft(likes[i] + table[:, model.languages.index(said) if said in words else 3] + np.log(prior))
        assert r.language.confidence == pytest.approx(p.max(), abs=1e-9)
        if r.language.lang != "und":
            assert r.language.lang == model.languages[int(p.argmax())]


def test_many_languages(spark):
    """No language with enough rows goes without a model, and many cost no more than in proportion."""
    rng = random.Random(1)
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(90)]
    words = {x: ["".join(chr(0x4E00 + 40 * i + rng.randint(0, 39)) for _ in range(4)) for _ in range(12)] for i, x in enumerate(names)}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(30)), x, "s") for k, x in enumerate(names * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(df)
    assert model.languages == sorted(names)
    found = language.documents_identified(df, model).collect()
    assert all(r.language.text_lang == r.lang and r.language.accepted for r in found)


def test_plain_markup():
    assert language.plain(b"<p>one<script>two</script>three<!-- x -->four &amp; five<b") == b" one three four   five<b"
    assert language.plain(b"a<style>b") == b"a " and language.plain(b"a<!--b") == b"a "
    began = time.perf_counter()
    language.plain(b"<script " * 40_000 + b"<!-- " * 40_000 + b"<a " * 40_000)
    assert time.perf_counter() - began < 2


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    stop = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def rule(host, path):
    fits = [(r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def word(host):
    return any(w in urls.SEEDS for w in re.split("[-.0-9]", host))


def ratio(text, counts):
    """Plain version of the two models."""
    total = 0.0
    for i in range(len(text)):
        gram, p = ("^^^^" + text)[i : i + 5], {}
        for kind in (0, 1):
            q = 1 / urls.ALPHABET
            for k in range(1, 6):
                event = sum(c[kind] for g, c in counts.items() if g.endswith(gram[5 - k :]))
                context = sum(c[kind] for g, c in counts.items() if g[5 - k : 4] == gram[5 - k : 4])
                q = (event + urls.BACKOFF * q) / (context + urls.BACKOFF)
            p[kind] = q
        total += math.log(p[0] / p[1])
    return total / len(text)


def test_urls(spark):
    made = ["http://A.Example.com/en/5", "https://b.example.com/en/77#x", "http://x.net/de/1?q=/", "http://example.net/de/8", "http://net/de/", "http://knet/de/", "ftp://org/es/", "http://example.org?/es/", None, "", "nohost", "http://", "http://spam.io/a", "http://good.io/a", "http://good.io/a", "http://é.fr/en/" + "z" * 300, "a://b://c/en/"]
    rng = random.Random(2)
    made += [f"http://{'casino-win' if i % 3 else 'best-bets2'}.io/{'win' * rng.randint(1, 3)}{rng.randint(1, 99)}" for i in range(60)]
    made += [f"http://alphabets.io/{rng.choice(['news', 'page', 'about'])}/{rng.randint(1, 99)}" for _ in range(90)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(made)], "page_id long, url string, host string")
    found = {r.page_id: r for r in urls.judged(df).collect()}
    counts, shown, classes = {}, {}, {}
    reads = ["".join("0" if c in "123456789" else c for c in (u or "").lower()) for u in made]
    held = {t: hash_of(t) % urls.FOLDS == 0 for t in reads}
    for u, text in zip(made, reads, strict=True):
        host, path = parts(u)
        name, verdict = rule(host, path)
        bad = verdict == "block" if name else word(host)
        classes.setdefault(text, [0, 0])[bad] += 1
        for i in range(len(text)):
            counts.setdefault(("^^^^" + text)[i : i + 5], [0, 0])[bad] += 1
            shown.setdefault(("^^^^" + text)[i : i + 5], [0, 0])[bad] += not held[text]
    for i, u in enumerate(made):
        r, (host, path) = found[i], parts(u)
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    bins = {}
    for text, n in classes.items():
        if held[text] and text:
            step = math.floor(ratio(text, shown) / urls.STEP)
            bins[step] = [a + b for a, b in zip(bins.get(step, [0, 0]), n, strict=True)]
    edge = urls.threshold([(k, *v) for k, v in bins.items()])
    scores = {t: ratio(t, counts) if t else 0.0 for t in set(reads)}
    for i, text in enumerate(reads):
        assert found[i].score == pytest.approx(scores[text], abs=1e-9)
        if not found[i].rule:
            assert found[i].verdict == ("allow" if scores[text] >= edge else "block")
    few = {r.page_id: r.verdict for r in urls.judged(df.where("page_id < 17")).collect()}
    assert few[12] == "block" and few[13] == "allow"
    assert {found[i].verdict for i in range(17, 77)} == {"block"} and {found[i].verdict for i in range(77, 167)} == {"allow"}
    assert urls.judged(df.where("false")).count() == 0
    assert {r.verdict for r in urls.judged(df.where("page_id in (13, 14)")).collect()} == {"allow"}


def test_long_urls(spark):
    """Work grows with a URL's length, not with its square."""
    made = [(1, "http://a.io/" + "spam-x/é" * 10_000), (2, "http://casino.io/"), (3, "http://b.io/x")]
    df = spark.createDataFrame(made, "page_id long, url string")
    urls.judged(df.where("page_id > 1")).collect()
    began = time.perf_counter()
    rows = spark.createDataFrame([(made[0][1],)], "url string").select(F.size(urls._grams(F.col("url"))).alias("n")).first()
    assert rows.n == len(made[0][1]) and time.perf_counter() - began < 2
    assert {r.page_id: r.verdict for r in urls.judged(df).collect()}[2] == "block"


def test_threshold():
    """The edge with the most right answers of both classes, by trying all."""
    rng = random.Random(7)
    for _ in range(30):
        bins = [(k, rng.randint(0, 9), rng.randint(0, 9)) for k in rng.sample(range(-40, 40), 12)]
        good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
        right = lambda edge: sum(g for k, g, _ in bins if k * urls.STEP >= edge - 1e-9) / good + sum(b for k, _, b in bins if (k + 1) * urls.STEP <= edge + 1e-9) / bad  # noqa: B023, E731
        best = max(right(k * urls.STEP) for k in range(-41, 42))
        assert right(round(urls.threshold(bins) / urls.STEP) * urls.STEP) == pytest.approx(best) or right(urls.threshold(bins)) == pytest.approx(best)
    assert urls.threshold([(1, 3, 0)]) == -math.inf and urls.threshold([]) == -math.inf
