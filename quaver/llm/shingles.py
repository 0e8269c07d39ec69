"""Near copies of documents: SimHash fingerprints propose, the exact Jaccard similarity of word shingles decides.

1. *Fingerprints.* Texts whose SimHash fingerprints link, as simhash.links_of() finds by deletion-variant signatures, are
   candidates.
2. *Prefixes.* Most texts that are just similar differ in more bits. Those that share a shingle of their prefixes are
   candidates too; no similar pair is without one.
3. *Verification.* Candidates are refused by sketches, and what is left is compared by the whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.llm import simhash
from quaver.llm.common import discard, materialize, small_batches
from quaver.llm.components import connected_components

#: Words of a shingle, and the Jaccard similarity of near copies as a fraction.
WORDS_EACH, SIMILAR = 5, (4, 5)
#: Texts that frequent shingles are told from, and the most of those that are sent to the tasks (8 bytes and a count each).
SAMPLED, MOST_FREQUENT = 65536, 1_000_000
#: Fewest longs of a sketch, and how many texts are picked by a broadcast of their digests (under 64 MB); beyond, by a shuffle.
SKETCH, BROADCAST_TEXTS = 16, 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D. Fewer words than a shingle holds make
    one shingle; so do no words at all.
    """
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in words], dtype="<u8")
    n = len(hashes) - WORDS_EACH + 1
    if n < 1:
        return np.array([digest(b" ".join(words), 1)], dtype="<u8")
    out = np.zeros(n, dtype="<u8")
    for i in range(WORDS_EACH):
        out = (out ^ hashes[i : i + n]) * _PRIME
        out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def _digest_column(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        found = np.array([set_digest(shingle_set(t)) for t in texts.to_pylist()], dtype="<u8")
        return pa.array(found.view("<i8"))

    return F.arrow_udf(run, "long")(text.cast("string"))


def _set_column(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t).view("<i8") for t in texts.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(text)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes in each of as many classes as it has shingles or more, a power of two of longs.

    Two sketches of a length differ in no more bits than there are shingles that one of the sets has and the other has
    not. The exclusive or of a sketch's halves is the sketch of half the length.
    """
    longs = max(SKETCH, 1 << ((len(shingles) + 63) // 64 - 1).bit_length())
    odd = np.bincount((shingles % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketch_column(text: Column) -> Column:
    """The size of a text's shingle set, then its sketch."""

    def run(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t) for t in texts.to_pylist()]
        return pa.array([np.concatenate([[len(x)], sketch(x)]) for x in sets], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(text)


def _prefix_batches(frequent: np.ndarray, counts: np.ndarray):
    """Texts to (s, h, size, place) of the shingles in the prefix of each set; a set is given once a task."""
    up, down = SIMILAR

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            parts, owners, sizes, places = [], [], [], []
            for text in batch.column(0).to_pylist():
                found = shingle_set(text)
                h = int(np.uint64(set_digest(found)).view("<i8"))
                if h in seen:
                    continue
                seen.add(h)
                n = len(found)
                keep = n - (up * n + down - 1) // down + 1
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                    count = np.where(frequent[at] == found, counts[at], 0)
                    if count.any():
                        found = found[np.lexsort((found, count))]
                parts.append(found[:keep])
                owners.append(np.full(keep, h, dtype="<i8"))
                sizes.append(np.full(keep, n, dtype="<i4"))
                places.append(np.arange(keep, dtype="<i4"))
            if parts:
                shingles = np.concatenate(parts).view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(shingles), *(pa.array(np.concatenate(x)) for x in (owners, sizes, places))], ["s", "h", "size", "place"])

    return run


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample's texts have, sorted, and how many. They only order sets: any sample is right."""
    total = texts.select(F.approx_count_distinct("text_id")).first()[0]
    share = max(1, total // SAMPLED)
    drawn = texts.where(F.pmod(F.xxhash64(F.col("text_id")), F.lit(share)) == 0)
    of = drawn.groupBy("text_id").agg(F.min("text").alias("text")).select(F.explode(_set_column(F.col("text"))).alias("s"))
    counted = materialize(of.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 2"), "shingles-frequent")
    found = counted.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).toArrow()
    discard(counted)
    shingles, counts = np.asarray(found.column("s")).view("<u8"), np.asarray(found.column("n")).astype("<i4")
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def _enough(shared: Column) -> Column:
    """Whether so many shingles shared by sets of size_a and size_b shingles make these SIMILAR."""
    up, down = SIMILAR
    return (up + down) * shared >= up * (F.col("size_a").cast("long") + F.col("size_b"))


def _print_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): sets of keys (h, fp) whose fingerprints are equal or link.

    A set is paired with the first of its fingerprint, the first ones of two fingerprints with each other.
    """
    prints = keys.select("h", "fp").distinct()
    first = materialize(prints.groupBy("fp").agg(F.min("h").alias("first")), "shingle-prints")
    equal = prints.join(first, "fp").select("h", "first")
    links = simhash.links_of(first).distinct()
    linked = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("h")), "a").join(first.select(F.col("fp").alias("b"), "first"), "b").select("h", "first")
    met = equal.union(linked).where("h <> first").select(F.least("h", "first").alias("a"), F.greatest("h", "first").alias("b"))
    found = materialize(met.distinct(), "shingle-print-pairs")
    discard(first)
    return found


def _near_pairs(shared: DataFrame) -> DataFrame:
    """Each set of a shingle's group with the group's first and with the one before, if this may be the first shingle shared.

    The order is one for all shingles, so that the sets of a family meet the same first one and make few pairs.
    """
    columns = ("h", "size", "place")
    order = W.partitionBy("s").orderBy("h")
    met = shared.select(
        *[F.col(c).alias(f"{c}_b") for c in columns],
        F.lag(F.struct(*columns)).over(order).alias("back"),
        F.first(F.struct(*columns)).over(order).alias("head"),
    ).where("back is not null")
    met = met.select("h_b", "size_b", "place_b", F.explode(F.array_distinct(F.array("back", "head"))).alias("o"))
    met = met.select("*", *[F.col(f"o.{c}").alias(f"{c}_a") for c in columns])
    met = met.where((F.col("h_a") != F.col("h_b")) & _enough(F.least(*[F.col(f"size_{x}") - F.col(f"place_{x}") for x in "ab"])))
    return met.select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b")).distinct()


def _most_at() -> Column:
    """The most shingles that two sets can share which share those at place_a and place_b."""
    left = [F.col(f"size_{x}") - F.col(f"place_{x}") for x in "ab"]
    return F.least("place_a", "place_b") + F.least(*left)


def _late_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components whose prefixes share as much as SIMILAR sets' do.

    Of two prefixes, that which ends first shares with the other set what the prefixes share, and no more than what is
    left of its set behind it; of the other set no more than what is left behind the last shingle shared.
    """
    up, down = SIMILAR
    rooted = shared.join(roots, shared.h == roots.node, "left").select("s", "h", "size", "place", F.coalesce("root", "h").alias("root"))
    split = rooted.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("s")
    left = rooted.join(split, "s")
    one, two = (left.select("s", *[F.col(c).alias(f"{c}_{side}") for c in ("h", "size", "place", "root")]) for side in "ab")
    met = one.join(two, "s").where("h_a < h_b and root_a <> root_b").where(_enough(_most_at()))
    last = F.max(F.struct("place_a", "place_b"))
    met = met.groupBy("h_a", "h_b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("shared"), last.alias("last"))
    behind = {x: F.expr(f"({up} * size_{x} + {down - 1}) div {down} - 1") for x in "ab"}
    after = {x: F.col(f"size_{x}") - 1 - F.col(f"last.place_{x}") for x in "ab"}
    most = F.col("shared") + F.greatest(F.least(behind["a"], after["b"]), F.least(behind["b"], after["a"]))
    return met.where(_enough(most)).select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))


def _differing() -> Column:
    """Bits in which the sketches bits_a and bits_b differ, the longer one folded; null if one is over twice as long."""
    xor = lambda x, y: x.bitwiseXOR(y)
    size = F.greatest(F.size("bits_a"), F.size("bits_b"))
    short = F.when(F.size("bits_a") < size, F.col("bits_a")).otherwise(F.col("bits_b"))
    long = F.when(F.size("bits_a") < size, F.col("bits_b")).otherwise(F.col("bits_a"))
    half = F.shiftright(size, 1)
    folded = F.zip_with(F.slice(long, F.lit(1), half), F.slice(long, half + 1, half), xor)
    long = F.when(F.size(short) < size, folded).otherwise(long)
    return F.aggregate(F.zip_with(long, short, xor), F.lit(0), lambda n, x: n + F.bit_count(x))


def _similar(pairs: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole shingle sets have a Jaccard similarity of SIMILAR or more."""
    up, down = SIMILAR
    pairs = materialize(pairs, "shingle-pairs")
    # Sets differ in at most (1 - t) / (1 + t) of both sizes. Sketches are an 8th of a byte a shingle, and most pairs go
    # by them: whole sets are sent once a pair.
    told = _rows_of(pairs, keys, texts).select("h", _sketch_column(F.col("text")).alias("told")).dropDuplicates(["h"])
    sketches = materialize(told.select("h", F.get("told", F.lit(0)).alias("size"), F.expr("slice(told, 2, size(told) - 1)").alias("bits")), "shingle-sketches")
    close = pairs
    for side in ("a", "b"):
        close = close.join(sketches.select(F.col("h").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    close = materialize(close.where((up + down) * _differing() <= (down - up) * (F.col("size_a") + F.col("size_b"))).select("a", "b"), "shingle-close")
    for done in (pairs, sketches):
        discard(done)
    of = _rows_of(close, keys, texts).groupBy("h").agg(F.min("text").alias("text"))
    sets = materialize(of.select("h", _set_column(F.col("text")).alias("set")), "shingle-sets")
    both = close.join(sets.select(F.col("h").alias("a"), F.col("set").alias("one")), "a").join(sets.select(F.col("h").alias("b"), F.col("set").alias("two")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("one", "two")).alias("shared"), (F.size("one") + F.size("two")).alias("both"))
    found = materialize(both.where(f"{up + down} * shared >= {up} * both").select("a", "b"), "shingle-links")
    for done in (sets, close):
        discard(done)
    return found


def _rows_of(pairs: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, text) of the sets that pairs (a, b) name, of one text each, as often as texts has it. None is shuffled while those are few."""
    named = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    first = materialize(keys.join(named, "h").groupBy("h").agg(F.min("text_id").alias("text_id")), "shingle-named")
    few = first.count() <= BROADCAST_TEXTS
    return texts.join(F.broadcast(first) if few else first, "text_id").select("h", "text")


def similar_links(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) digests of sets, of keys (text_id, h, fp) and texts (text_id, text): links whose components are those of all pairs that are SIMILAR.

    Sets whose fingerprints link are compared first. The rest is for those that these do not tell: with all shingles in one order, two sets of a Jaccard similarity of t share a shingle among the first
    n - ceil(t n) + 1 of each, so no pair is lost. The order is by hash, those frequent in a sample last. Sets that share
    such a shingle are compared with two others each as well; pairs of different components that are left are all compared,
    if the prefixes share as much as they must: 4 of 9 of their shingles, where sizes are equal.
    """
    keyed = texts.select("text").mapInArrow(_prefix_batches(*_frequent(texts)), "s long, h long, size int, place int")
    keyed = keyed.repartition("s").dropDuplicates(["s", "h"])
    several = keyed.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("s"))).where("n > 1")
    shared = materialize(several.select("s", "h", "size", "place"), "shingles-shared")
    printed = _print_pairs(keys)
    near = _similar(printed.union(_near_pairs(shared)).distinct(), keys, texts)
    roots = materialize(connected_components(near), "shingle-roots")
    discard(printed)
    discard(near)
    late = _similar(_late_pairs(shared, roots), keys, texts)
    discard(shared)
    links = materialize(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late), "shingle-all-links")
    discard(roots)
    discard(late)
    return links


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies: its smallest doc_id, all columns kept, whatever their names.

    Texts whose sets of word shingles have a Jaccard similarity of SIMILAR or more, over steps as well, are one
    component. Null and empty texts are equal. Rows without an id give way to rows with one; of rows that repeat an id
    and have equal sets one stays. An empty table gives an empty result. Sets are told apart by a 64-bit digest.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    text, id_ = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    key = [id_.isNull().alias("none"), F.coalesce(id_, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("text_id")]
    keys = materialize(docs.select(*key, _digest_column(F.col("text")).alias("h"), simhash.fingerprint_column(F.col("text"), WORDS_EACH).alias("fp")), "shingle-keys")
    links = similar_links(keys.select("text_id", "h", "fp").distinct(), docs.select(F.xxhash64(text).alias("text_id"), text.alias("text")))
    roots = connected_components(links)
    classes = keys.groupBy("h").agg(F.min(F.struct("none", "id", "text_id")).alias("first"))
    rooted = classes.join(roots, classes.h == roots.node, "left").select("first", F.coalesce("root", "h").alias("root"))
    stays = materialize(rooted.groupBy("root").agg(F.min("first").alias("one")).select("one.*"), "shingle-stays")
    for done in (links, keys):
        discard(done)
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("kept")
    rows = docs.select(kept, *key).join(stays, ["none", "id", "text_id"], "left_semi")
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("none", "id", "text_id").orderBy(F.xxhash64(F.col("kept").cast("string"))))).where("at = 1")
    return rows.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)])
