"""Language identification by Bayesian fusion of evidence.

log P(language | all) is the sum of a text likelihood (hashed byte trigrams), the likelihood of the language that markup
declares, and the logarithm of a prior of the host. Host priors are smoothed by those of the host's domain, these by the
address suffix's, and these by the whole table's: each level is a grouped aggregation of what texts say alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import materialize

#: The text model is fitted on about this many labelled texts of each language at most.
FIT_ROWS = 300
#: Languages with a smaller share of the labelled rows have no model; so there are 1000 at most, of 128 kB each.
LEAST_SHARE = 0.001
BUCKET_BITS, SMOOTHING = 15, 0.5
#: Trigrams that count as independent evidence at most; weight of the next level of a prior, in rows.
EVIDENCE, PRIOR_ROWS = 40.0, 5.0
#: Rows of each language that are taken to declare it, before any row is seen.
DECLARED_ROWS = 20.0
#: Below the lowest mean likelihood of training texts less MARGIN a text is in no language known; posteriors under
#: LEAST are rejected.
MARGIN, LEAST = 1.5, 0.5
#: Hosts up to this many are broadcast (under 64 MB); beyond, the join is a shuffle that splits hot hosts.
BROADCAST_HOSTS = 200_000
_SKIP = re.compile(rb"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>|&[a-z#0-9]{1,8};")
_BLANKS = re.compile(rb"\s+")


def plain(markup: bytes) -> bytes:
    """Text of an HTML page: scripts, styles, comments (to the end, if nothing closes them), tags and entities go."""
    return _SKIP.sub(b" ", markup)


def _grams(text: bytes) -> np.ndarray:
    data = np.frombuffer(b" " + _BLANKS.sub(b" ", text.lower()).strip() + b" ", dtype=np.uint8).astype(np.uint32)
    if len(data) < 4:
        return np.empty(0, dtype=np.uint32)
    return ((data[:-2] | data[1:-1] << 8 | data[2:] << 16) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


class TextModel:
    """Log-probabilities of hashed trigrams in each language, and the lowest mean that counts as a language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        rows = [[_grams(t.encode()) for t in texts[x]] for x in self.languages]
        table = np.stack([np.bincount(np.concatenate([*r, np.empty(0, np.uint32)]).astype(np.int64), minlength=1 << BUCKET_BITS) for r in rows]) + SMOOTHING if rows else np.empty((0, 1 << BUCKET_BITS))
        self.table = np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)) if rows else table.T
        own = [self.table[g, i].mean() for i, r in enumerate(rows) for g in r if len(g) >= 30]
        self.floor = float(np.quantile(own, 0.001) - MARGIN) if own else -np.inf

    def evidence(self, text: bytes) -> list[float]:
        """Mean log-likelihood in each language, then the number of trigrams."""
        grams = _grams(text)
        if not len(grams):
            return [0.0] * len(self.languages) + [0.0]
        total = np.zeros(len(self.languages))
        for at in range(0, len(grams), 1 << 16):
            total += self.table[grams[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return [*(total / len(grams)).tolist(), float(len(grams))]


def fit(docs: DataFrame) -> TextModel:
    """Text model from rows (doc_id, text, lang), a bounded sample of each language; null and empty languages, and those
    of less than LEAST_SHARE of the labelled rows, are left out."""
    known = docs.where("lang is not null and lang <> '' and text is not null").select("doc_id", "text", F.lower("lang").alias("lang"))
    counts = known.groupBy("lang").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    sizes = {r.lang: r["count"] for r in counts.where(F.col("count") >= LEAST_SHARE * total).collect()}  # 1 / LEAST_SHARE rows at most
    if not sizes:
        return TextModel({})
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, FIT_ROWS / n) * (1 << 30))))])
    drawn = known.where(draw < F.try_element_at(share, F.col("lang"))).orderBy(draw, "doc_id").limit(2 * FIT_ROWS * len(sizes)).collect()
    texts: dict[str, list[str]] = {}
    for r in drawn:
        texts.setdefault(r.lang, []).append(r.text)
    return TextModel(texts)


def _evidence_udf(model: TextModel, markup: bool):
    def run(texts: pa.Array) -> pa.Array:
        out = [model.evidence(plain(t.encode()) if markup else t.encode()) for t in (x or "" for x in texts.to_pylist())]
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def declared_in(html: Column) -> Column:
    """Primary subtag of the lang attribute of the html element, in lower case; empty without one."""
    return F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _with(value: Column, use) -> Column:
    """use(value), where value is evaluated once: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _posterior(parts: list[Column], languages: int) -> Column:
    """array<double> of probabilities from arrays of log-scores."""
    total = F.transform(F.sequence(F.lit(0), F.lit(languages - 1)), lambda i: sum((F.get(p, i) for p in parts[1:]), F.get(parts[0], i)))
    raised = _with(total, lambda t: _with(F.array_max(t), lambda most: F.transform(t, lambda x: F.exp(x - most))))
    return _with(raised, lambda r: _with(F.aggregate(r, F.lit(0.0), lambda a, b: a + b), lambda whole: F.transform(r, lambda x: x / whole)))


def identified(rows: DataFrame, model: TextModel, text: str, declared: Column, host: Column, markup: bool, name: str = "language") -> DataFrame:
    """rows with one more column, of that name: struct<lang, confidence, text_lang, declared, host, accepted>.

    lang is the language with the largest posterior, or 'und' where a text of 30 trigrams or more is unlike all
    languages known. Accepted are rows that are not 'und' and whose posterior is LEAST or more. A null or empty text is
    no evidence: its declared language and its host's prior decide. Null hosts and declarations count as empty ones,
    which are values of their own. All columns of rows are kept, whatever their names; repeated rows are each judged.
    Without any language to choose from, and for an empty table, rows come back with lang 'und', not accepted.
    """
    spark = rows.sparkSession
    names = rows.columns
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("kept")
    back = [F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)]
    n = len(model.languages)
    seen = rows.select(kept, F.coalesce(declared, F.lit("")).alias("declared"), F.coalesce(host, F.lit("")).alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    if not n:
        none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), "declared", "host", F.lit(False).alias("accepted"))
        return seen.select(*back, none.alias(name))
    seen = seen.withColumn("e", _evidence_udf(model, markup)("text")).drop("text")
    grams = F.get("e", F.lit(n))
    likes = F.transform(F.slice("e", 1, n), lambda x: x * F.least(grams, F.lit(EVIDENCE)))
    seen = seen.withColumn("likes", likes).withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)).withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    seen = seen.withColumn("alone", _posterior([F.col("likes")], n))
    seen = materialize(seen.withColumn("said", F.when(F.col("declared").isin(model.languages), F.col("declared")).otherwise("")), "language")

    sums = [F.sum(F.get("alone", F.lit(i))).alias(f"n{i}") for i in range(n)]
    # P(declared | language): what texts say of each declaration; (languages + 1) ** 2 numbers
    table = np.full((n, n + 1), 1.0)
    table[np.arange(n), np.arange(n)] += DECLARED_ROWS
    for r in seen.groupBy("said").agg(*sums).collect():
        at = model.languages.index(r.said) if r.said else n
        table[:, at] += [r[f"n{i}"] for i in range(n)]
    table = np.log(table / table.sum(axis=1, keepdims=True))
    says = F.when(F.lit(False), F.array(*[F.lit(0.0)] * n))
    for at, word in enumerate([*model.languages, ""]):
        says = says.when(F.col("said") == word, F.array(*[F.lit(float(x)) for x in table[:, at]]))

    hosts = seen.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("rows"), *sums)
    hosts = materialize(hosts, "hosts")
    totals = hosts.agg(F.sum("rows").alias("rows"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]).first()
    prior = [F.lit(((totals[f"n{i}"] or 0.0) + 1.0) / ((totals["rows"] or 0) + n)) for i in range(n)]
    for level in ("suffix", "domain", "host"):
        counts = {"rows": F.col("rows")} | {str(i): F.col(f"n{i}") for i in range(n)}
        if level == "host":  # a row each already
            hosts = hosts.select("*", *[c.alias(f"host_{k}") for k, c in counts.items()])
        else:
            of = hosts.groupBy(level).agg(*[F.sum(c).alias(f"{level}_{k}") for k, c in counts.items()])
            hosts = hosts.join(of, level)
        prior = [(F.col(f"{level}_{i}") + PRIOR_ROWS * p) / (F.col(f"{level}_rows") + PRIOR_ROWS) for i, p in enumerate(prior)]
    priors = materialize(hosts.select(F.col("host").alias("h"), F.array(*[F.log(p) for p in prior]).alias("prior")), "priors")
    if priors.count() <= BROADCAST_HOSTS:
        priors = F.broadcast(priors)
    fused = seen.join(priors, seen.host == F.col("h")).withColumn("p", _posterior([F.col("likes"), says, F.col("prior")], n))
    named = F.array(*[F.lit(x) for x in model.languages])
    best, alone = F.array_max("p"), F.array_max("alone")
    strange = (grams >= 30) & (F.array_max(F.slice("e", 1, n)) < model.floor)
    lang = F.when(strange, "und").otherwise(F.get(named, F.array_position("p", best) - 1))
    text_lang = F.when(strange | (grams == 0), "und").otherwise(F.get(named, F.array_position("alone", alone) - 1))
    told = F.struct(lang.alias("lang"), best.alias("confidence"), text_lang.alias("text_lang"), "declared", "host", (~strange & (best >= LEAST)).alias("accepted"))
    return fused.select(*back, told.alias(name))


def pages_identified(pages: DataFrame, model: TextModel) -> DataFrame:
    """identified() of web pages (url, html)."""
    return identified(pages, model, "html", declared_in(F.col("html")), host_of(F.col("url")), True)


def documents_identified(docs: DataFrame, model: TextModel, name: str = "language") -> DataFrame:
    """identified() of documents (text, lang, source): lang is what was declared, source stands for the host."""
    return identified(docs, model, "text", F.lower("lang"), F.col("source"), False, name)


def query(spark, sf_dir):
    """op5: language of every page (page_id) and of every document (doc_id)."""
    from quaver.llm.common import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    model = fit(docs)
    pages = pages_identified(table(spark, sf_dir, "pages", "page_id", "url", "html"), model)
    told = documents_identified(docs, model).select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id"), "language.*")
    return told.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "language.*"))
