"""URL filter: rules first, else the ratio of two character language models. DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import discard, materialize

#: The rules (verdict, host and start of the path) of the query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Hosts with one of these as a word of their name are taken as rejected when the models are trained.
SEEDS = ("spam", "pills", "casino", "bets", "porn", "viagra")
#: Longest string that the models count, weight of the next shorter context, and characters assumed.
ORDER, BACKOFF, ALPHABET = 5, 4.0, 64
#: One in so many URLs is held out of the models that the threshold is calibrated with.
FOLDS = 5
#: Steps of the normalised score in which the threshold is looked for, and its range.
STEP, RANGE = 0.02, 8.0
#: A table of strings up to this many rows is broadcast (under 32 MB); beyond, the join is a shuffle that splits hot keys.
BROADCAST_STRINGS = 250_000


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; empty without '://'."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty without '://'."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with the rule's. Rules are few and given by the caller:
    they become one CASE, tried from the longest on.
    """
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def seeded(host: Column, seeds=SEEDS) -> Column:
    """Whether a seed is a word of the host: between its ends, dots, hyphens and digits."""
    return host.rlike(rf"(^|[.\-0-9])({'|'.join(seeds)})([.\-0-9]|$)") if seeds else F.lit(False)


def _grams(text: Column) -> Column:
    """Each character with those before it, ORDER in all, as UTF-32, where places need no search; the start is padded."""
    units = F.array(F.encode(F.concat(F.lit("^" * (ORDER - 1)), text), "UTF-32"))
    starts = lambda u: F.sequence(F.lit(1), F.octet_length(u) - (4 * ORDER - 1), F.lit(4))
    return F.get(F.transform(units, lambda u: F.transform(starts(u), lambda i: F.substring(u, i, F.lit(4 * ORDER)))), F.lit(0))


def _last(gram: Column, first: int, characters: int) -> Column:
    return F.substring(gram, 4 * (ORDER - first) + 1, 4 * characters)


def string_ratios(grams: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """gram, and for each (accepted, rejected) of kinds a ratio: log P(last character | those before it) in the first
    model less that in the second one, named ratio0, ratio1, ...

    grams: gram and counts, one row a gram. The models are of variable order: each context's estimate is smoothed by that
    of the context one shorter, down to an even spread, so contexts that were not seen leave it to shorter ones. Strings
    and contexts of each length are grouped counts, joined to the strings one longer: no key has more rows than there are
    characters to follow it.
    """
    names = [n for pair in kinds for n in pair]
    events = grams.select("gram", *names)
    totals = grams.agg(*[F.sum(n).cast("double").alias(n) for n in names]).first()
    shorter = None
    for k in range(1, ORDER + 1):
        of = events.groupBy(_last(F.col("gram"), k, k).alias("s")).agg(*[F.sum(n).alias(n) for n in names])
        if k == 1:
            p = {n: (F.col(n) + BACKOFF / ALPHABET) / ((totals[n] or 0.0) + BACKOFF) for n in names}
        else:
            context = of.groupBy(F.substring("s", 1, 4 * (k - 1)).alias("c")).agg(*[F.sum(n).alias(f"of_{n}") for n in names])
            of = of.withColumn("c", F.substring("s", 1, 4 * (k - 1))).join(context, "c")
            of = of.withColumn("t", F.substring("s", 5, 4 * (k - 1))).join(shorter, "t")
            p = {n: (F.col(n) + BACKOFF * F.col(f"p_{n}")) / (F.col(f"of_{n}") + BACKOFF) for n in names}
        shorter = of.select(F.col("s").alias("t"), *[p[n].alias(f"p_{n}") for n in names])
    ratios = [(F.log(f"p_{a}") - F.log(f"p_{b}")).alias(f"ratio{i}") for i, (a, b) in enumerate(kinds)]
    return shorter.select(F.col("t").alias("gram"), *ratios)


def threshold(bins: list[tuple[int, float, float]]) -> float:
    """Score at and above which URLs are accepted: where the rates of right answers of both classes sum up to most.

    bins: (number of the score step, accepted, rejected). Ties go to the middle of the range that is as good.
    """
    bins = sorted(bins)
    at = np.array([b for b, _, _ in bins], dtype=float)
    good, bad = (np.array([b[i] for b in bins], dtype=float) for i in (1, 2))
    if not good.sum() or not bad.sum():
        return -np.inf
    right = (good.sum() - np.concatenate([[0], np.cumsum(good)])) / good.sum() + np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = int(np.argmax(right))
    low = at[best - 1] + 1 if best else at[0]
    high = at[best] if best < len(at) else at[-1] + 1
    return float((low + high) / 2 * STEP)


def judged(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score of every row of pages (page_id, url).

    The verdict is the rule's where one fits. Else the models decide: rejected are URLs that a rule blocks and, where no
    rule fits, hosts with a seed as a word; accepted are all others, so unruled URLs serve as background. Both models
    count every URL of the table. The score is the log-likelihood ratio per character of the lower-cased URL, digits taken
    as one character. It is held against a threshold that is calibrated on one in FOLDS of the different URLs, by scores
    of models that have not counted these (or on all of them, if a class has none held out). If either class is empty all
    unruled URLs are allowed. A null URL, or one without '://', has empty host and path, fits no rule and is judged by
    its characters; an empty one has score 0. Repeated rows are each returned; an empty table gives an empty result;
    other columns are ignored.

    URLs that read alike are one text, scored once. Strings and their counts are joined by string; counts are aggregated
    before they are shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    text = F.translate(F.lower("url"), "123456789", "000000000")
    bad = F.when(F.col("found").isNull(), seeded(F.col("host"), seeds)).otherwise(F.col("found.verdict") == "block")
    rows = materialize(rows.select("page_id", "host", "path", "found.rule", "found.verdict", text.alias("read"), bad.cast("int").alias("bad")), "urls")

    texts = rows.groupBy("read").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad")).where("read <> ''")
    texts = materialize(texts.withColumn("held", F.pmod(F.xxhash64("read"), F.lit(FOLDS)) == 0), "url-texts")
    strings = texts.select("n", "n_bad", "read", "held", F.explode(_grams(F.col("read"))).alias("gram"))
    good, shown = F.col("n") - F.col("n_bad"), F.when(F.col("held"), 0).otherwise(1)
    counts = strings.groupBy("gram").agg(
        F.sum(good).alias("accepted"), F.sum("n_bad").alias("rejected"), F.sum(good * shown).alias("shown_accepted"), F.sum(F.col("n_bad") * shown).alias("shown_rejected"),
    )
    counts = materialize(counts, "url-strings")
    ratios = materialize(string_ratios(counts, [("accepted", "rejected"), ("shown_accepted", "shown_rejected")]), "url-ratios")
    known = F.broadcast(ratios) if ratios.count() <= BROADCAST_STRINGS else ratios
    scored = strings.select("read", "held", "gram").join(known, "gram").groupBy("read", "held").agg(F.avg("ratio0").alias("score"), F.avg("ratio1").alias("blind"))
    scored = materialize(scored.join(texts.select("read", "n", "n_bad"), "read"), "url-scores")

    def edge_of(held: DataFrame, score: str) -> float:
        step = F.floor(F.greatest(F.least(score, F.lit(RANGE)), F.lit(-RANGE)) / STEP)
        bins = held.groupBy(step.alias("step")).agg(F.sum(good).alias("good"), F.sum("n_bad").alias("bad")).collect()  # 2 * RANGE / STEP rows at most
        return threshold([(r.step, r.good, r.bad) for r in bins])

    edge = edge_of(scored.where("held"), "blind")
    if edge == -np.inf:
        edge = edge_of(scored, "score")
    rows_scored = rows.join(scored.select("read", "score"), "read", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    for done in (texts, counts, ratios):
        discard(done)
    by_score = F.when(F.col("score") >= F.lit(float(edge)), F.lit("allow")).otherwise(F.lit("block"))
    return rows_scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_score).alias("verdict"), "score")


def query(spark, sf_dir):
    """op9: host, path, rule and verdict of every page."""
    from quaver.llm.common import table

    return judged(table(spark, sf_dir, "pages", "page_id", "url"))
