"""Packing documents into sequences of tokens along a space-filling curve."""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048
END_ID = 1
#: Hashed features of a document, dimensions they are projected to, and bits of the curve in each.
FEATURES, DIMENSIONS, CURVE_BITS = 256, 4, 15
_CHUNK = 1 << 21


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points (rows of integers below 2**bits), after J. Skilling (2004)."""
    x = points.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & np.uint64(q)) != 0, flip ^ np.uint64(q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


@lru_cache(1)
def _signs() -> np.ndarray:
    return np.random.default_rng(20240).choice((-1.0, 1.0), (FEATURES, DIMENSIONS))


def curve_keys(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hilbert keys of texts (UTF-8 bytes that end at ends): hashed four-byte strings, projected by random signs."""
    starts = np.concatenate([[0], ends[:-1]])
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    grams = np.empty(len(data) + 4, dtype="<u4")
    for phase in range(4):
        part = padded[phase : phase + (len(padded) - phase) // 4 * 4].view("<u4")
        grams[phase::4] = part[: len(grams[phase::4])]
    slot = (grams[: len(data)] * np.uint32(0x9E3779B1)) >> np.uint32(24)
    row = np.repeat(np.arange(len(ends), dtype=np.int64) * FEATURES, ends - starts)
    spot = row + slot
    for back in (1, 2, 3):  # strings that would reach into the next text
        at = ends - back
        spot[at[at >= starts]] = -1
    counts = np.bincount(spot[spot >= 0], minlength=len(ends) * FEATURES).reshape(len(ends), FEATURES).astype(float)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    z = (counts @ _signs()) / np.maximum(norm, 1e-9)
    point = (1 / (1 + np.exp(-1.702 * z)) * (1 << CURVE_BITS)).astype(np.int64).clip(0, (1 << CURVE_BITS) - 1)
    return hilbert_key(point, CURVE_BITS)


def _curve_key(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype="<i4", count=len(texts) + texts.offset + 1)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    keys, at = [np.empty(0, np.uint64)], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        keys.append(curve_keys(data[offsets[at] : offsets[to]], (offsets[at + 1 : to + 1] - offsets[at]).astype(np.int64)))
        at = to
    return pa.array(np.concatenate(keys).astype(np.int64))


@lru_cache(2)
def encoder(vocabulary: str):
    """Text to ids of a byte-level BPE vocabulary file of `tokenizers`, without adding special tokens.

    The file's ids are its ranks, so `tiktoken` gives the same ids as `tokenizers` in a quarter of its time. The strings
    of special tokens in a text become their ids, as `tokenizers` does it by default.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {x["content"]: x["id"] for x in file["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    made = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> array:
        if any(s in text for s in special):
            return array("I", made.encode(text, allowed_special="all"))
        return array("I", made.encode_ordinary(text))

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def tail_lengths(n: int) -> list[int]:
    """Powers of two that sum up to n, largest first: what is left of a partition is cut into these, without padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_batches(vocabulary: str, sequence: int):
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches):
        encode, first, number = encoder(vocabulary), TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []  # pieces of the open sequence: doc_id, start, ids, doc_tokens
        filled, out = 0, [[] for _ in names]

        def put(pieces):
            nonlocal number
            offset = 0
            for doc_id, start, ids, size in pieces:
                for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids), size, first + number, offset), strict=True):
                    column.append(value)
                offset += len(ids)
            number += 1

        def flush():
            nonlocal out
            rows, out = out, [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)

        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = encode(texts[i].as_py())
                ids.append(END_ID)
                at = 0
                while at < len(ids):
                    take = min(sequence - filled, len(ids) - at)
                    held.append((doc_id, at, ids[at : at + take], len(ids)))
                    at, filled = at + take, filled + take
                    if filled == sequence:
                        put(held)
                        held, filled = [], 0
            yield flush()
        for length in tail_lengths(filled):
            pieces = []
            while length:
                doc_id, start, ids, size = held.pop(0)
                pieces.append((doc_id, start, ids[:length], size))
                if len(ids) > length:
                    held.insert(0, (doc_id, start + length, ids[length:], size))
                length -= len(pieces[-1][2])
            put(pieces)
        yield flush()

    return run


def packed(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, partitions: int | None = None) -> DataFrame:
    """Pieces of the documents (doc_id, text) in sequences of at most ``sequence`` tokens.

    Documents are range-partitioned and sorted along a Hilbert curve through few random projections of their hashed
    byte strings, so that neighbours are alike, and are laid one after another; a document is cut where a sequence is
    full. Each partition packs for itself: its last tokens become sequences of power-of-two lengths, which need no
    padding. sequence_id is unique; its upper part is the partition.

    A document's tokens are the ids of its whole text and the end id; null and empty texts have the end id alone. Null
    doc_ids stay null. Rows that repeat a document are packed each. An empty table gives an empty result; other columns
    are ignored. ids are hashed as little-endian unsigned 32-bit integers.
    """
    vocabulary = vocabulary or default_vocabulary()
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("curve", F.arrow_udf(_curve_key, "long")("text"))
    order = ["curve", "doc_id"]
    rows = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order, F.xxhash64("text"))
    return rows.select("doc_id", "text").mapInArrow(_pack_batches(vocabulary, sequence), _SCHEMA)


def query(spark, sf_dir):
    """op7: where each piece of every document lies."""
    from quaver.llm.common import table

    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))
