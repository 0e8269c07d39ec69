"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.llm.common import materialize
from quaver.llm.components import connected_components

#: Fingerprints link at this many differing bits or fewer.
MAX_BITS = 3
#: A group of this many fingerprints or more is cut once more by equal bytes of the other half.
LARGE_GROUP = 4096
_BLOCK = 1 << 15


def simhash(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half the hashes of the word shingles.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D. Fewer words than a shingle holds make
    one shingle; null and empty texts, and texts of white space only, have fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, seed) for x in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words_each: int = 3) -> Column:
    """simhash() of a column of texts as a long."""

    def run(texts: pa.Array) -> pa.Array:
        prints = np.array([simhash(t, words_each) for t in texts.to_pylist()], dtype="<u8")
        return pa.array(prints.view("<i8"))

    return F.arrow_udf(run, "long")(text.cast("string"))


def _signature_batches(batches):
    """Each fingerprint under its two halves, and under each half with one bit deleted: 2 + 2 * 32 keys."""
    spots = np.arange(32, dtype=np.uint64)
    for batch in batches:
        prints = np.asarray(batch.column(0)).view("<u8")
        keys = []
        for side in (0, 1):
            half = (prints >> np.uint64(32)) if side else (prints & np.uint64(0xFFFFFFFF))
            tag = np.uint64(side << 40)
            keys.append((half | tag | np.uint64(32 << 32))[:, None])
            keys.append((half[:, None] & ~(np.uint64(1) << spots)) | tag | (spots << np.uint64(32)))
        keys = np.concatenate(keys, axis=1)
        again = np.repeat(prints, keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view("<i8")), pa.array(again.view("<i8"))], ["key", "fp"])


def _spanning(group: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Links that hold together what links within a bit distance of MAX_BITS hold together: at most one a member."""
    links, left = [], group
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = np.bitwise_count(left ^ one) <= MAX_BITS
            if near.any():
                found = left[near]
                links.append((one, found))
                queue.extend(found)
                left = left[~near]
    return links


def _links_of_group(key: int, group: np.ndarray) -> list[tuple[int, np.ndarray]]:
    side, spot = key >> 40 & 1, key >> 32 & 63
    half = group >> np.uint64(32) if side else group & np.uint64(0xFFFFFFFF)
    if spot < 32:
        bit = half >> np.uint64(spot) & np.uint64(1)
        if bit.min() == bit.max():  # halves are equal: their whole-half key has this group too
            return []
    if len(group) < LARGE_GROUP:
        return _spanning(group)
    other, links = (group & np.uint64(0xFFFFFFFF) if side else group >> np.uint64(32)), []
    for byte in range(4):  # of three differing bits at most, at least one byte in four has none
        value = other >> np.uint64(8 * byte) & np.uint64(255)
        order = np.argsort(value, kind="stable")
        for part in np.split(group[order], np.flatnonzero(np.diff(value[order])) + 1):
            links += _spanning(part)
    return links


def _link_batches(batches):
    """Batches sorted by key to links; a group may span batches, and holds 8 bytes a distinct fingerprint."""
    held_key, held = None, np.empty(0, dtype="<u8")

    def out(pairs):
        if pairs:
            a = np.concatenate([np.full(len(found), one, dtype="<u8") for one, found in pairs])
            b = np.concatenate([found for _, found in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, prints = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view("<u8")
        if held_key is not None:
            keys = np.concatenate([np.full(len(held), held_key, dtype="<i8"), keys])
            prints = np.concatenate([held, prints])
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        held_key, held = int(keys[-1]), prints[starts[-1] :]
        sizes = np.diff(starts)
        twos = starts[:-1][sizes == 2]
        near = np.bitwise_count(prints[twos] ^ prints[twos + 1]) <= MAX_BITS
        pairs = [(prints[i], prints[i + 1 : i + 2]) for i in twos[near]]
        for at, size in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            pairs += _links_of_group(int(keys[at]), prints[at : at + size])
        yield from out(pairs)
    if len(held) > 1:
        yield from out(_links_of_group(held_key, held))


def links_of(classes: DataFrame) -> DataFrame:
    """(a long, b long): links of distinct fingerprints (fp) whose components are those of all within MAX_BITS bits.

    Fingerprints within three bits agree but for one bit at most in one half of 32 bits, so they share that half or one
    of its 32 variants with a bit deleted. They are dealt by signature, verified by bit distance, and each signature's
    group gives a spanning set of links, never all pairs.
    """
    signed = classes.select("fp").mapInArrow(_signature_batches, "key long, fp long")
    return signed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_batches, "a long, b long")


def components(prints: DataFrame) -> DataFrame:
    """(fp long, least long, root long) of every distinct fingerprint of prints (doc_id, fp).

    Equal fingerprints are one class, found before the shuffle; links_of() joins classes. least is the smallest doc_id of
    the fingerprint (null if it has null ones only), root a fingerprint that stands for the component.
    """
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links_of(classes))
    rooted = classes.join(roots, classes.fp == roots.node, "left")
    return materialize(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-classes")


def near_duplicates(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp long, component_id long.

    component_id is the smallest doc_id reachable, itself included; null doc_ids never are one. Null and empty texts have
    fingerprint 0 and link like any other. Repeated rows are each returned; an empty table gives an empty result; other
    columns are ignored.
    """
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), words_each).alias("fp"))
    prints = materialize(prints, "simhash")
    rooted = components(prints)
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(best, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """docs with one row of each component: its smallest doc_id, all columns kept, whatever their names.

    Rows without an id give way to rows with one; of rows that repeat an id and a fingerprint one stays, that whose
    columns have the least hash.
    """
    names = docs.columns
    last = F.lit((1 << 63) - 1)
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("kept")
    rows = docs.select(kept, F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), fingerprint_column(F.col("text"), words_each).alias("fp"))
    rows = materialize(rows, "simhash-rows")
    rooted = components(rows.select("doc_id", "fp"))
    stays = rooted.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("one")).select(F.col("one.least").alias("doc_id"), F.col("one.fp").alias("fp"))
    rows = rows.join(stays, ["doc_id", "fp"], "left_semi")
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("doc_id", "fp").orderBy(F.xxhash64(F.col("kept").cast("string"))))).where("at = 1")
    return rows.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)])


def query(spark, sf_dir):
    """op2: fingerprint and component of every document."""
    from quaver.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
