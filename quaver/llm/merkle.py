"""Document fingerprints as Merkle trees over paragraphs and sections. DataFrame functions only.

A section is a line; its paragraphs are its sentences, those over ``PIECE`` code points cut again. Pieces are found from
the start of their sentence and section on, so an edit changes the digests of what it touches and of what holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Code points of a paragraph at most, and hexadecimal digits of its digest in a fingerprint.
PIECE, DIGITS = 40, 6
#: Ranges of doc_id: quantiles, each cut evenly.
MAX_QUANTILES = 512
_LAST = (1 << 63) - 1


def tree(text: Column) -> Column:
    """array<struct<digest long, leaves array<int>>>: a section's digest and short digests of its paragraphs."""
    piece = F.lit(rf"[^.!?]{{1,{PIECE}}}[.!?]*|[.!?]+")
    hashes = F.transform(F.split(text, "\n"), lambda s: F.transform(F.regexp_extract_all(s, piece, F.lit(0)), lambda p: F.xxhash64(p)))
    mask = F.lit((1 << 4 * DIGITS) - 1)
    return F.transform(
        hashes,
        lambda h: F.struct(F.xxhash64(h).alias("digest"), F.transform(h, lambda x: x.bitwiseAND(mask).cast("int")).alias("leaves")),
    )


def root(sections: Column) -> Column:
    """Digest over the sections' digests: equal texts have equal roots."""
    return F.substring(F.sha2(F.concat_ws("/", F.transform(sections, lambda s: F.hex(s["digest"]))), 256), 1, 32)


def branches(sections: Column) -> Column:
    """array<string>: of each section its digest as 16 digits, '.', and its paragraphs' digits."""
    return F.transform(
        sections,
        lambda s: F.lower(F.concat(F.lpad(F.hex(s["digest"]), 16, "0"), F.lit("."), F.array_join(F.transform(s["leaves"], lambda x: F.lpad(F.hex(x), DIGITS, "0")), ""))),
    )


def fingerprint(sections: Column) -> Column:
    """root ':' then the branches, set apart by '/'."""
    return F.concat(root(sections), F.lit(":"), F.array_join(branches(sections), "/"))


def likeness(a: Column, b: Column) -> Column:
    """Share of paragraphs that two trees have in common (0 to 1), of their branches(), from the roots down.

    Equal roots give 1. Sections that both have count with all their paragraphs and are not looked into; only of the
    sections that differ paragraphs are compared, as sets. Trees that differ and have no paragraphs give 0.
    """

    def leaves(sections: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(F.substring(s, F.lit(18), F.length(s)), F.lit(f".{{{DIGITS}}}"), F.lit(0)))))

    one, two = leaves(F.array_except(a, b)), leaves(F.array_except(b, a))
    whole = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.floor((F.length(s) - 17) / DIGITS).cast("int"))
    shared, both = whole + F.size(F.array_intersect(one, two)), 2 * whole + F.size(one) + F.size(two)
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * shared, both), F.lit(0.0)))


def edits(a: Column, b: Column) -> Column:
    """array<struct<section int, paragraphs array<int>>>: where tree a has sections, and in them paragraphs, that the
    section of the same number in b has not. Equal branches are not looked into."""
    numbered = F.transform(a, lambda s, i: F.struct(i.alias("section"), s.alias("mine"), F.get(b, i).alias("other")))
    differing = F.filter(numbered, lambda x: ~x["mine"]["digest"].eqNullSafe(x["other"]["digest"]))

    def spots(x):
        pieces = F.transform(x["mine"]["leaves"], lambda leaf, i: F.when(~leaf.eqNullSafe(F.get(x["other"]["leaves"], i)), i))
        return F.struct(x["section"].alias("section"), F.filter(pieces, lambda p: p.isNotNull()).alias("paragraphs"))

    return F.transform(differing, spots)


def _range(ids: DataFrame, parts: int):
    """Column expression of the number of the range an id falls in, ranges being of about equal size."""
    quantiles = min(parts, MAX_QUANTILES)
    found = ids.where("id < " + str(_LAST)).approxQuantile("id", [i / quantiles for i in range(quantiles + 1)], 0.2 / quantiles)
    edges = sorted({int(x) for x in found})
    if len(edges) < 2:
        return lambda c: F.lit(0).cast("long")
    each = max(1, -(-parts // (len(edges) - 1)))
    lower = F.array(*[F.lit(x).cast("long") for x in edges])

    def number(c: Column) -> Column:
        at = F.greatest(F.size(F.filter(lower, lambda x: x <= c)), F.lit(1))
        low, high = F.get(lower, at - 1), F.get(lower, F.least(at, F.lit(len(edges) - 1)))
        inside = F.when(high > low, F.floor((F.least(c, high) - low).cast("double") / (high - low) * each)).otherwise(0)
        return (at * (each + 1) + F.least(F.greatest(inside, F.lit(0)), F.lit(each))).cast("long")

    return number


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tree, next_text, next_tree): each document beside the next one by doc_id; the first follows the last.

    Ids are cut into ranges, and each range also gets the first document of the next one, so that a window over a range
    sees every successor with one shuffle of the texts. Null texts are empty, null ids come last; rows that repeat an id
    follow one another in the order of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(_LAST)))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"))
    number = _range(ids, parts)
    firsts = ids.withColumn("part", number(F.col("id"))).groupBy("part").agg(F.min("id").alias("first")).orderBy("part").collect()  # one row a range
    if not firsts:
        ahead = docs.sparkSession.createDataFrame([], "first long, before long")
    else:
        ahead = docs.sparkSession.createDataFrame([(r.first, firsts[i - 1].part) for i, r in enumerate(firsts)], "first long, before long")
    rows = rows.withColumn("tree", tree(F.col("text")))
    rows = rows.join(F.broadcast(ahead), rows.id == ahead["first"], "left")
    own = F.struct(number(F.col("id")).alias("part"), F.lit(False).alias("ahead"))
    other = F.struct(F.col("before").alias("part"), F.lit(True).alias("ahead"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))))
    order = W.partitionBy("at.part").orderBy("at.ahead", "id", "text")
    rows = rows.select("doc_id", "text", "tree", "at", F.lead("text").over(order).alias("next_text"), F.lead("tree").over(order).alias("next_tree"))
    return rows.where("not at.ahead").drop("at")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits of every row.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's. edits tells which sections and paragraphs of the edited text differ. Null texts are empty: they have one
    section without paragraphs. A single document follows itself; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = with_next(docs).withColumn("n", F.length("text")).withColumn("cut", F.floor(F.col("n") / 4).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("cut")), F.substring(F.col("next_text"), F.lit(1), F.col("cut")))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n", "tree", "next_tree", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("edited")).alias("edited_tree"))
    trees = {"of": "tree", "edited_of": "edited_tree", "next_of": "next_tree"}
    rows = rows.select("*", *[branches(F.col(t)).alias(name) for name, t in trees.items()])
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        fingerprint(F.col("tree")).alias("fingerprint"), fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("of"), F.col("edited_of")).alias("near_edited"), likeness(F.col("of"), F.col("next_of")).alias("near_next"),
        edits(F.col("edited_tree"), F.col("tree")).alias("edits"),
    )


def query(spark, sf_dir):
    """op6: fingerprints of every document and of its edited text, how near they are, and which branches the edit changed."""
    from quaver.llm.common import table

    return fingerprinted(table(spark, sf_dir, "documents", "doc_id", "text"))
