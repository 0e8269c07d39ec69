"""Exact substring de-duplication with a sparse suffix array dealt over sampled splitters.

Positions of documents are UTF-8 bytes. A string of ``width`` bytes is removed where an equal one starts earlier.

1. *Anchors.* Every window of ``ANCHOR_SPAN`` bytes elects one of its positions by its content alone, so equal strings
   of ``width`` bytes hold an anchor at the same offset, at most ``REACH`` from their start. Only suffixes that start
   at anchors (about one byte in thirty) enter the suffix array.
2. *Leading bytes.* A suffix is dealt by its leading bytes (three of them, then a digest of the first ``LEAD``) over
   splitters sampled from the corpus. Splitters are pairs (leading bytes, text), so the suffixes of one hot string are
   split over buckets. Buckets are sorted (spilling); suffixes alone with their leading bytes drop out.
3. *Contexts.* The others fetch the bytes around them and are dealt again, by splitters sampled from contexts. In its
   bucket each group of equal leading bytes is sorted by multikey quicksort, on the bytes from the suffix's start on and
   then on those before it; a context equal to its predecessor's is a repeat as a whole. Suffixes whose leading bytes
   meet in several contexts are compared at each offset, within the bucket where the group is whole. Of groups that a
   bucket boundary cuts (all hot groups are) each part sends the windows that it holds first, each offset its own suffix,
   through one more range partition, where they are compared across boundaries.
4. Repeats become byte intervals, dealt to their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import discard, materialize, small_batches

WIDTH = 100
#: Bytes that a suffix in the array is first compared by, and the k-gram that elects anchors.
LEAD, GRAM = 40, 8
#: Suffixes sampled for each bucket's splitter.
SAMPLED_PER_BUCKET = 60
#: Texts whose digests clash, of which a handful is expected at any size.
MOST_CLASHES = 10_000
_CHUNK = 1 << 21
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a big-endian number (past the end: zeros)."""
    padded = np.zeros((len(data) + 7) // 8 * 8 + 16, dtype=np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(padded) - 8, dtype="<u8")
    for phase in range(8):
        part = padded[phase : phase + (len(padded) - phase) // 8 * 8].view(">u8")
        out[phase::8] = part[: len(out[phase::8])]
    return out[: len(data)]


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each full window, by minima from the left and from the right in blocks of its width."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype="<u8")
    padded[: len(x)] = x
    shaped = padded.reshape(blocks, width)
    left = np.minimum.accumulate(shaped, axis=1).ravel()
    right = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions in data, which holds texts that end at ends, and a key of the leading bytes of each."""
    span = width - LEAD + GRAM  # the anchor's leading bytes then lie in any string of the width that elects it
    if len(data) < span:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype="<i8")
    words = _words(data)
    rank = (_mix(words.copy()) >> np.uint64(28) << np.uint64(28)) | np.arange(len(data), dtype="<u8")
    best = (_window_min(rank[: len(data) - GRAM + 1], span - GRAM + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(len(best) + 1, dtype=np.int32)
    long = ends - starts >= width
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - width + 1, -1)
    best = best[np.cumsum(whole[:-1]) > 0]
    if not len(best):
        return best, np.empty(0, dtype="<i8")
    at = best[np.concatenate([[True], best[1:] != best[:-1]])]
    lead = np.zeros(len(at), dtype="<u8")
    for i in range(0, LEAD, 8):
        lead = _mix(lead ^ words[at + i])
    key = (words[at] >> np.uint64(40) << np.uint64(40)) | (lead >> np.uint64(24))
    return at, key.view("<i8")


def _chunks(batch, binary: int):
    """Rows of the batch in runs of up to _CHUNK bytes: first row, bytes, ends."""
    column = batch.column(binary)
    column = column.cast(pa.binary()) if column.type != pa.binary() else column
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4", count=len(column) + column.offset + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], (offsets[at + 1 : to + 1] - offsets[at]).astype(np.int64)
        at = to


def _anchor_batches(width: int, splits=None):
    """(text, data) to (key, text, pos) of every anchor, and its bucket if there are splitters."""

    def run(batches):
        for batch in batches:
            texts = np.asarray(batch.column(0))
            for first, data, ends in _chunks(batch, 1):
                at, key = anchors(data, ends, width)
                row = np.searchsorted(ends, at, "right")
                pos = at - np.concatenate([[0], ends[:-1]])[row]
                text = texts[first + row]
                out = [pa.array(key), pa.array(text), pa.array(pos.astype("<i4"))]
                if splits is not None:
                    out.append(pa.array(bucket(key, text, *splits).astype("<i4")))
                yield pa.RecordBatch.from_arrays(out, ["key", "text_id", "pos", "bucket"][: len(out)])

    return run


def bucket(key: np.ndarray, text: np.ndarray, split_keys: np.ndarray, split_texts: np.ndarray) -> np.ndarray:
    """Number of splitters (key, text), in order, that are not above each pair."""
    low, high = np.searchsorted(split_keys, key, "left"), np.searchsorted(split_keys, key, "right")
    out = low.copy()
    for at in np.flatnonzero(high > low):
        out[at] = low[at] + np.searchsorted(split_texts[low[at] : high[at]], text[at], "right")
    return out


def _candidate_batches(batches):
    """Sorted (key, text_id, pos): those that share their key with another. The bucket's first and last always stay."""
    held, first = None, True  # first: the bucket's first run has not ended yet
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(i)) for i in range(3)]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
        key = rows[0]
        same = key[1:] == key[:-1]
        other = same & ((rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]))
        # of equal rows (copies of a text) the first stands for all; a run's first row looks at the run's last
        fresh = np.concatenate([[True], ~same | other])
        run = np.cumsum(np.concatenate([[True], ~same])) - 1
        mixed = np.bincount(run, weights=np.concatenate([[0], other])) > 0
        tail = run == run[-1]
        keep = fresh & (mixed[run] | (first & (run == 0))) & ~tail
        yield _record(rows[1][keep], rows[2][keep])
        first = first and not run[-1]
        held = [r[tail & fresh] for r in rows]
    if held is not None:
        yield _record(held[1], held[2])


def _record(text, pos):
    return pa.RecordBatch.from_arrays([pa.array(text), pa.array(pos)], ["text_id", "pos"])


def _context_batches(width: int, splits=None):
    """(doc, data, spots, text_id) to key and text_id of each spot; with splitters also its bucket, place and bytes around."""
    reach = width - LEAD

    def run(batches):
        for batch in batches:
            docs, spots, texts = batch.column(0), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.uint8)
                at = np.asarray(spots[i].values).astype(np.int64)
                lead = np.zeros(len(at), dtype="<u8")
                words = _words(data)
                for k in range(0, LEAD, 8):
                    lead = _mix(lead ^ words[at + k])
                key = ((words[at] >> np.uint64(40) << np.uint64(40)) | (lead >> np.uint64(24))).view("<i8")
                text = np.full(len(at), texts[i].as_py(), dtype="<i8")
                out = {"key": pa.array(key), "text_id": pa.array(text)}
                if splits is not None:
                    left, right = np.minimum(at, reach), np.minimum(len(data) - at, width)
                    raw = data.tobytes()
                    context = [raw[a - l : a + r] for a, l, r in zip(at, left, right, strict=True)]
                    out |= {"bucket": pa.array(bucket(key, text, *splits).astype("<i4")), "doc": pa.array(np.full(len(at), docs[i].as_py(), dtype="<i8"))}
                    out |= {"pos": pa.array(at.astype("<i4")), "lft": pa.array(left.astype("<i2")), "context": pa.array(context, pa.binary())}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def multikey_order(rows: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (bytes, equally long) by multikey quicksort, eight bytes a key, and the class of each in it.

    Rows are split by one key at a time, and only those that tie on it are split by the next one. Equal rows stay in
    their order and are one class. Rows that are sorted into groups before are sorted within these.
    """
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.reshape(len(rows), -1, 8).view(">u8")[:, :, 0].astype("<u8")
    order = np.arange(len(rows))
    group = np.zeros(len(rows), dtype=np.int64) if group is None else group.copy()
    for depth in range(words.shape[1]):
        tied = np.bincount(group)[group] > 1 if len(group) else np.empty(0, dtype=bool)
        if not tied.any():
            break
        part, of = order[tied], group[tied]
        order[tied] = part[np.lexsort((words[part, depth], of))]
        value = words[order, depth]
        group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | ((value[1:] != value[:-1]) & tied[1:] & tied[:-1])])) - 1
    return order, group


def _repeats(context: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, width: int):
    """Of aligned contexts (anchor in column width - LEAD): (row, offset) whose window an earlier row has too."""
    reach = width - LEAD
    prefix = np.zeros((context.shape[1] + 1, len(context)), dtype="<u8")
    for i in range(context.shape[1]):
        prefix[i + 1] = prefix[i] * _BASE + context[:, i] + np.uint64(1)
    power = np.uint64(pow(int(_BASE), width, 1 << 64))
    rows, offsets = [], []
    for offset in range(reach + 1):
        valid = np.flatnonzero((left >= offset) & (right >= width - offset))
        if len(valid) < 2:
            continue
        start = reach - offset
        value = prefix[start + width][valid] - prefix[start][valid] * power
        order = valid[np.lexsort((rank[valid], value))]
        value = prefix[start + width][order] - prefix[start][order] * power
        same = np.flatnonzero(value[1:] == value[:-1]) + 1
        if len(same):
            window = context[:, start : start + width]
            equal = (window[order[same]] == window[order[same - 1]]).all(axis=1)
            if not equal.all():  # digests collide: order by the bytes themselves
                by_rank = valid[np.argsort(rank[valid])]
                order = by_rank[multikey_order(window[by_rank])[0]]
                same = np.flatnonzero((window[order[1:]] == window[order[:-1]]).all(axis=1)) + 1
            rows.append(order[same])
            offsets.append(np.full(len(same), offset))
    return (np.concatenate(rows), np.concatenate(offsets)) if rows else (np.empty(0, int), np.empty(0, int))


_OUT = ["kind", "doc", "text_id", "start", "stop", "high", "low"]


def _array_batches(width: int):
    """Sorted suffixes with context to intervals (kind 0) and to windows of groups that the bucket's ends cut (kind 1)."""
    reach = width - LEAD

    def record(kind, doc, text, start, stop, high=None, low=None):
        n, zero = len(doc), np.zeros(len(doc), dtype="<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, dtype="<i4")), pa.array(np.asarray(doc, dtype="<i8")), pa.array(np.asarray(text, dtype="<i8")), pa.array(np.asarray(start, dtype="<i8")), pa.array(np.asarray(stop, dtype="<i8")), pa.array(zero if high is None else high), pa.array(zero if low is None else low)],
            _OUT,
        )

    def aligned(context, left):
        """The contexts as rows of bytes, those before the anchor in the first columns; beyond a text's ends: zeros."""
        size = np.array([len(x) for x in context], dtype=np.int64)
        data = np.frombuffer(b"".join(context) + b"\0", dtype=np.uint8)
        begin = np.cumsum(size) - size
        at = np.arange(reach + width) - (reach - left)[:, None]
        inside = (at >= 0) & (at < size[:, None])
        return np.where(inside, data[np.where(inside, begin[:, None] + at, 0)], 0).astype(np.uint8)

    def windows(doc, text, pos, left, context):
        """Of a part of a group: windows that repeat within the part, as intervals; of the others, each window's digest."""
        if not len(doc):
            return
        pos, left = pos.astype("<i8"), left.astype("<i8")
        row, offset = yield from repeats(doc, text, pos, left, context)
        known = np.zeros((len(doc), reach + 1), dtype=bool)
        known[row, offset] = True
        out = [], [], [], [], []
        for i, (d, t, p, l, x) in enumerate(zip(doc.tolist(), text.tolist(), pos.tolist(), left.tolist(), context, strict=True)):
            for at in range(0, min(l + 1, len(x) - width + 1)):
                if known[i, l - at]:
                    continue
                sum_ = hashlib.blake2b(x[at : at + width], digest_size=16).digest()
                for o, v in zip(out, (d, t, p - l + at, int.from_bytes(sum_[:8], "little", signed=True), int.from_bytes(sum_[8:], "little", signed=True)), strict=True):
                    o.append(v)
            if len(out[0]) > 50_000 or i == len(doc) - 1:
                doc_, text_, start, high, low = (np.array(o, dtype="<i8") for o in out)
                yield record(1, doc_, text_, start, start + width, high, low)
                out = [], [], [], [], []

    def whole(doc, text, pos, left, size):
        """The bytes of all windows of a context that an earlier one equals."""
        right = size - left
        shortest = np.maximum(0, width - right)
        fits = shortest <= left
        return record(0, doc[fits], text[fits], (pos - left)[fits], (pos - shortest + width)[fits])

    def repeats(doc, text, pos, left, context):
        """Yields the intervals of windows that repeat among these rows; returns them as (row, offset)."""
        part = aligned(context, left)
        size = np.array([len(x) for x in context])
        rank = np.lexsort((pos, text, doc))
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        row, offset = _repeats(part, left, size - left, place, width)
        if len(row):
            order = np.lexsort((offset, row))
            row, offset = row[order], offset[order]
            cut = np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)])
            first, last = np.flatnonzero(cut), np.concatenate([np.flatnonzero(cut)[1:], [len(row)]]) - 1
            yield record(0, doc[row[first]], text[row[first]], pos[row[first]] - offset[last], pos[row[first]] - offset[first] + width)
        return row, offset

    def run(batches):
        held, started, last = None, False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(i)) for i in range(5)] + [np.array(batch.column(5).to_pylist() + [None], dtype=object)[:-1]]
            fresh = np.ones(len(rows[0]), dtype=bool)  # a repeated row gives each of its suffixes again
            fresh[1:] = np.any([r[1:] != r[:-1] for r in rows[:4]], axis=0)
            fresh[0] = last != [r[0] for r in rows[:4]]
            last = [r[-1] for r in rows[:4]]
            if not fresh.any():
                continue
            rows = [r[fresh] for r in rows]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            # What is held comes first and is earlier, so that of equal contexts the first one is the earliest.
            part, left = aligned(rows[5], rows[4].astype("<i8")), rows[4].astype("<u2")
            size = np.array([len(x) for x in rows[5]], dtype="<u2")
            lengths = np.stack([left, size], axis=1).view(np.uint8).reshape(len(left), -1)
            groups = np.cumsum(np.concatenate([[0], rows[0][1:] != rows[0][:-1]]))
            order, classes = multikey_order(np.concatenate([part[:, reach:], part[:, :reach], lengths], axis=1), groups)
            rows = [r[order] for r in rows]
            same = np.concatenate([[False], classes[1:] == classes[:-1]])
            if same.any():
                yield whole(rows[1][same], rows[2][same], rows[3][same].astype("<i8"), rows[4][same].astype("<i8"), size[order][same].astype("<i8"))
            rows = [r[~same] for r in rows]
            key = rows[0]
            body = key != key[-1]
            if not started and body.any():
                cut = key == key[0]
                yield from windows(*[r[cut] for r in rows[1:]])
                started, body = True, body & ~cut
            if body.any():
                inner = [r[body] for r in rows]
                many = np.concatenate([[False], inner[0][1:] == inner[0][:-1]])
                many[:-1] |= many[1:]
                if many.any():
                    inner = [r[many] for r in inner]
                    yield from repeats(inner[1], inner[2], inner[3].astype("<i8"), inner[4].astype("<i8"), inner[5])
            held = [r[key == key[-1]] for r in rows]
            if not started and len(held[0]) > 20_000:  # a hot key that began before this bucket: nothing to wait for
                yield from windows(*held[1:])
                held = [h[-1:] for h in held]
        if held is not None:
            yield from windows(*held[1:])

    return run


def _boundary_batches(batches):
    """Sorted windows: repeats of their predecessor; the bucket's first and last are told of as well (kind 2 and 3)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, doc, text, start = (np.asarray(batch.column(i)) for i in range(5))
        if last is None:
            yield _window_record(2, high[:1], low[:1], doc[:1], text[:1], start[:1])
            joined = [high, low, doc, text, start]
        else:
            joined = [np.concatenate([a, b]) for a, b in zip(last, (high, low, doc, text, start), strict=True)]
        high, low, doc, text, start = joined
        same = np.flatnonzero((high[1:] == high[:-1]) & (low[1:] == low[:-1]) & ((doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1]))) + 1
        yield _window_record(0, high[same], low[same], doc[same], text[same], start[same])
        last = [x[-1:] for x in joined]
    if last is not None:
        yield _window_record(3, *last)


def _window_record(kind, high, low, doc, text, start):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, dtype="<i4")), *map(pa.array, (high, low, doc, text, start))], ["kind", "high", "low", "doc", "text_id", "start"])


def _removal_batches(width: int):
    """(doc_id, data, n, is_first, spans) to the digest columns; a later copy of a text goes as a whole."""

    def run(batches):
        for batch in batches:
            size, spans_of, kept = [], [], []
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py() or b""
                spans = merged(batch.column(3)[i].as_py() or [])
                if not batch.column(2)[i].as_py() and len(data) >= width:
                    spans = [(0, len(data))]
                size.append(len(data))
                spans_of.append([{"start": a, "stop": b} for a, b in spans])
                at, sha = 0, hashlib.sha256()
                for a, b in spans:
                    sha.update(data[at:a])
                    at = b
                sha.update(data[at:])
                kept.append(sha.hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(spans_of, kind), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "spans", "kept_sha256"])

    return run


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted intervals, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, stop: removed bytes), kept_sha256 of every row of docs (doc_id, text).

    A byte is removed if a string of ``width`` bytes that covers it also starts earlier (smaller doc_id, or the same
    document at an earlier start) in the input. Null texts are empty. Null doc_ids come after all others. Different
    texts under one id, or under none, are documents of their own, in the order of their digests; rows with equal ids and
    texts are one document, and each is returned. Texts shorter than the width lose nothing. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_, least = F.col("doc_id").cast("long"), -(1 << 63) + 1
    narrow = docs.select(
        id_.alias("id"), F.when(id_.isNull(), F.lit((1 << 63) - 1)).otherwise(F.greatest(id_, F.lit(least)) - 1).alias("doc"),  # one less, so that none is as large as what stands for null
        F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("data"),
    )
    narrow, classes = _told_apart(narrow)

    sorted_ = _dealt(narrow.select("text_id", "data"), width).sortWithinPartitions("key", "text_id", "pos")
    found = sorted_.select("key", "text_id", "pos").mapInArrow(_candidate_batches, "text_id long, pos int")
    spots = found.groupBy("text_id").agg(F.array_sort(F.collect_set("pos")).alias("spots")).join(classes.select("text_id", "doc"), "text_id")
    spots = materialize(spots, "spots")
    texts = narrow.select("id", "doc", "data", "text_id")
    of = spots.select("doc", F.col("text_id").alias("of"), "spots")

    def contexts(chosen: DataFrame, splits, columns: str) -> DataFrame:
        found = chosen.join(of, (chosen.doc == of.doc) & (chosen.text_id == F.col("of"))).select(chosen.doc, "data", "spots", "text_id")
        return found.mapInArrow(_context_batches(width, splits), columns)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = _splitters(texts, lambda some: contexts(some, None, "key long, text_id long"), spots.count(), parts)
    around = contexts(texts, splits, "key long, text_id long, bucket int, doc long, pos int, lft short, context binary")
    around = around.repartitionById(parts, "bucket").sortWithinPartitions("key", "doc", "text_id", "pos").select("key", "doc", "text_id", "pos", "lft", "context")
    split = materialize(around.mapInArrow(_array_batches(width), "kind int, doc long, text_id long, start long, stop long, high long, low long"), "repeats")

    discard(spots)
    windows = split.where("kind = 1").select("high", "low", "doc", "text_id", "start")
    windows = windows.repartitionByRange(parts, "high", "low", "doc", "text_id", "start").sortWithinPartitions("high", "low", "doc", "text_id", "start")
    told = materialize(windows.mapInArrow(_boundary_batches, "kind int, high long, low long, doc long, text_id long, start long"), "windows")
    last = told.where("kind = 3").groupBy("high", "low").agg(F.min(F.struct("doc", "text_id", "start")).alias("one"))
    cut = told.where("kind = 2").join(last, ["high", "low"]).where("one < struct(doc, text_id, start)")
    spans = (
        split.where("kind = 0").select("doc", "text_id", "start", "stop")
        .union(told.where("kind = 0").unionByName(cut.select(told.columns)).select("doc", "text_id", "start", (F.col("start") + width).alias("stop")))
        .groupBy("doc", "text_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    )
    first = classes.join(spans, ["doc", "text_id"], "left").select(F.col("text_id").alias("of"), F.col("doc").alias("at"), F.col("id").alias("of_id"), "spans")
    whole = (
        texts.join(first, (texts.doc == first["at"]) & (texts.text_id == first["of"]) & texts.id.eqNullSafe(first["of_id"]), "left")
        .select(F.col("id").alias("doc_id"), "data", F.col("at").isNotNull().alias("is_first"), "spans")
    )
    return whole.mapInArrow(_removal_batches(width), "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept_sha256 string")


def _told_apart(narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """narrow (id, doc, data) with text_id, a 64-bit digest of the text, and (text_id, doc, id) of the first row of each text.

    Texts are held to be equal by 128 bits. Different texts that share the first 64 (a few of ten thousand million do) get
    other digests, until no two have the same.
    """
    text_id, check, others = F.xxhash64("data"), F.xxhash64(F.lit("again"), "data"), []
    while True:
        rows = narrow.withColumn("text_id", text_id)
        classes = rows.groupBy("text_id").agg(F.min("doc").alias("doc"), F.min("id").alias("id"), F.min(check).alias("a"), F.max(check).alias("b"))
        classes = materialize(classes.select("text_id", "doc", "id", (F.col("a") != F.col("b")).alias("clash")), "texts")
        clash = [r.text_id for r in classes.where("clash").select("text_id").limit(1 + MOST_CLASHES).collect()]
        if not clash:
            return rows, classes.select("text_id", "doc", "id")
        if len(clash) > MOST_CLASHES:
            raise ValueError("digests of texts are not spread as digests are")
        others.append(len(others))
        text_id = F.when(text_id.isin(clash), F.xxhash64(F.lit(len(others)), F.lit("other"), "data")).otherwise(text_id)


def _splitters(texts: DataFrame, suffixes, rows: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters (key, text_id) for the suffixes (key, text_id, ...) of texts, from those of a sample of the texts."""
    wanted = parts * SAMPLED_PER_BUCKET
    share = max(1, rows * 20 // wanted)  # each text gives many
    sample = suffixes(texts.where(F.pmod(F.col("text_id"), F.lit(share)) == 0))
    drawn = sample.select("key", "text_id").withColumn("draw", F.xxhash64("key", "text_id", F.rand(5))).orderBy("draw").limit(wanted).collect()
    drawn = sorted((r.key, r.text_id) for r in drawn)
    splits = [drawn[len(drawn) * i // parts] for i in range(1, parts)] if drawn else []
    return np.array([k for k, _ in splits], dtype="<i8"), np.array([t for _, t in splits], dtype="<i8")


def _dealt(texts: DataFrame, width: int) -> DataFrame:
    """Anchors of (text_id, data), dealt to buckets between sampled splitters."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = "key long, text_id long, pos int"
    splits = _splitters(texts, lambda some: some.mapInArrow(_anchor_batches(width), columns), texts.count(), parts)
    return texts.mapInArrow(_anchor_batches(width, splits), columns + ", bucket int").repartitionById(parts, "bucket")


def query(spark, sf_dir):
    """op8: what repeated strings of 100 bytes remove from every document."""
    from quaver.llm.common import table

    found = repeated_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
