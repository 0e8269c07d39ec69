"""Toxicity by a linear-chain conditional random field over words.

The labels are of documents, so words are labelled first: a word of a toxic document is toxic if it, or its beginning,
is found in toxic documents almost only. The field learns from those labels, with the words' beginnings as features, and
passes on to inflected and unseen forms. Forward-backward marginals tag spans; their sums make a document's score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.simhash import simhash

#: The field is fitted on this many labelled documents of each class at most; all documents are scored.
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
#: Words of a training window, windows without toxic words, and rounds of training.
WINDOW, CLEAN_WINDOWS, ROUNDS = 16, 8_000, 50
#: A word or beginning marks toxic words if so large a share of the documents with it are toxic, and so small is the
#: probability that any part does so by chance. Texts within so many bits of a fingerprint count as copies.
MARK_SHARE, MARK_CHANCE, COPY_BITS = 0.8, 0.05, 10
FEATURE_BITS = 18
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


def features(word: str) -> list[int]:
    """Hashed features of a word, which is lower-cased: itself and its beginnings of three to six letters."""
    parts = ["=" + word, *(word[:n] for n in range(3, min(6, len(word)) + 1))]
    return [xxhash.xxh32_intdigest(p) >> (32 - FEATURE_BITS) for p in parts]


def distinct_rows(texts: list[str]) -> np.ndarray:
    """Numbers of the texts that are no near copies of an earlier one, by bit distance of their fingerprints."""
    prints = np.array([simhash(t) for t in texts], dtype="<u8")
    kept: list[int] = []
    seen = np.empty(len(texts), dtype="<u8")
    for i, x in enumerate(prints):
        if not (np.bitwise_count(seen[: len(kept)] ^ x) <= COPY_BITS).any():
            seen[len(kept)] = x
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def marks(texts: list[str], labels: np.ndarray) -> set[str]:
    """Words (with '=' before) and beginnings that mark toxic words.

    Such a part is in toxic documents in a larger share than chance among all parts explains, and at least MARK_SHARE.
    """
    found = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        words = {w.lower() for w in _WORD.findall(text)}
        found[int(label)].update({"=" + w for w in words} | {w[:n] for w in words for n in (4, 5, 6) if len(w) >= n})
    share = float(labels.mean())
    needed = np.log(max(1, len(found[1])) / MARK_CHANCE)
    out = set()
    for p, n in found[1].items():
        q = n / (n + found[0][p])
        if q > share:
            gain = n * np.log(q / share) + (found[0][p] * np.log((1 - q) / (1 - share)) if found[0][p] else 0.0)
            if gain >= needed and q >= max(MARK_SHARE, share):
                out.add(p)
    return out


class Field:
    """Two states (clean, toxic): a word's toxic score is the sum of its features' weights and a bias."""

    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray, ends: np.ndarray):
        self.weights, self.bias, self.moves, self.head = weights, bias, moves, ends
        self.known: dict[str, float] = {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        out = np.empty(len(words))
        for i, w in enumerate(words):
            v = known.get(w)
            if v is None:
                v = known[w] = self.bias + float(self.weights[features(w.lower())].sum())
            out[i] = v
        return out

    def marginals(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(toxic) of each word; sequences lie one after another in scores, and run in step, the longest first."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        (a, b), (c, d) = np.exp(self.moves)
        e = np.exp(np.clip(scores, -50, 50))
        forward, backward = np.empty(len(scores)), np.empty(len(scores))
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        ratio = np.empty(0)
        for t, n in enumerate(active):  # forward: odds of toxic, given the words so far
            at = starts[:n] + t
            ratio = e[at] * (np.exp(self.head[1] - self.head[0]) if t == 0 else (b + d * ratio[:n]) / (a + c * ratio[:n]))
            forward[at] = ratio
        ratio = np.ones(len(starts))
        for t in range(len(active) - 1, -1, -1):  # backward: odds of the words to come
            n = active[t]
            at = starts[:n] + t
            more = np.zeros(n, dtype=bool)
            more[: active[t + 1] if t + 1 < len(active) else 0] = True
            x = e[np.minimum(at + 1, len(e) - 1)] * backward[np.minimum(at + 1, len(e) - 1)]
            backward[at] = np.where(more, (c + d * x) / (a + b * x), 1.0)
        odds = forward * backward
        return odds / (1 + odds)


def fit_field(words: np.ndarray, states: np.ndarray, lengths: np.ndarray | None = None) -> Field:
    """Fits the field to windows: words (windows x WINDOW x features, -1 for none) and states (windows x WINDOW).

    lengths tells how many words a window has, if not all: what lies past them takes no part. Maximises the conditional log-likelihood of the states by AdaGrad; expected counts come from forward-backward.
    """
    size = 1 << FEATURE_BITS
    theta, bias, moves, head = np.zeros(size + 1), -2.0, np.zeros((2, 2)), np.zeros(2)
    sums = [np.full(size + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    n, width = states.shape
    index = np.where(words < 0, size, words)
    known = np.arange(width) < (np.full(n, width) if lengths is None else lengths)[:, None]
    both = known[:, 1:]
    seen_moves = np.array([[((states[:, :-1] == i) & (states[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)])
    seen_head = np.array([(states[:, 0] == i).sum() for i in (0, 1)])
    for _ in range(ROUNDS):
        theta[size] = 0.0
        score = theta[index].sum(axis=2) + bias
        e = np.stack([np.ones_like(score), np.exp(np.clip(score, -40, 40))], axis=2)
        m = np.exp(moves)
        f, b = np.empty_like(e), np.ones_like(e)
        f[:, 0] = e[:, 0] * np.exp(head)
        f[:, 0] /= f[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, width):
            f[:, t] = (f[:, t - 1] @ m) * e[:, t]
            f[:, t] /= f[:, t].sum(axis=1, keepdims=True)
        for t in range(width - 2, -1, -1):
            b[:, t] = np.where(known[:, t + 1, None], (b[:, t + 1] * e[:, t + 1]) @ m.T, 1.0)
            b[:, t] /= b[:, t].sum(axis=1, keepdims=True)
        p = f * b
        p = p / p.sum(axis=2, keepdims=True)
        pair = f[:, :-1, :, None] * m[None, None] * (e * b)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        miss = np.where(known, states - p[:, :, 1], 0.0) / n
        grads = [
            np.bincount(index.ravel(), weights=np.repeat(miss.ravel(), index.shape[2]), minlength=size + 1) - 1e-7 * theta,
            float(miss.sum()),
            (seen_moves - (pair * both[:, :, None, None]).sum(axis=(0, 1))) / n,
            (seen_head - p[:, 0].sum(axis=0)) / n,
        ]
        for k, g in enumerate(grads):
            sums[k] = sums[k] + g * g
        theta += 0.5 * grads[0] / np.sqrt(sums[0])
        bias += 0.3 * grads[1] / np.sqrt(sums[1])
        moves += 0.2 * grads[2] / np.sqrt(sums[2])
        head += 0.2 * grads[3] / np.sqrt(sums[3])
    theta[size] = 0.0
    return Field(theta, float(bias), moves, head)


def _windows(texts: list[str], labels: np.ndarray, marked: set[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover every word of the texts (features, states, lengths): all with a toxic word, a share of others."""
    rng, cache = np.random.default_rng(11), {}
    toxic, clean = [], []
    for text, label in zip(texts, labels, strict=True):
        found = [w.lower() for w in _WORD.findall(text)]
        tags = np.zeros(len(found), dtype=np.int64)
        if label:
            tags[:] = [("=" + w) in marked or any(w[:n] in marked for n in (4, 5, 6) if len(w) >= n) for w in found]
        for at in range(0, len(found), WINDOW):
            window = found[at : at + WINDOW], tags[at : at + WINDOW]
            if window[1].any():
                toxic.append(window)
            elif rng.random() < 0.2:
                clean.append(window)
    rng.shuffle(clean)
    windows = toxic + clean[:CLEAN_WINDOWS]
    out, states = np.full((len(windows), WINDOW, 5), -1, dtype=np.int64), np.zeros((len(windows), WINDOW), dtype=np.int64)
    for i, (window, tags) in enumerate(windows):
        states[i, : len(tags)] = tags
        for j, w in enumerate(window):
            f = cache.get(w) or cache.setdefault(w, features(w))
            out[i, j, : len(f)] = f
    return out, states, np.array([len(tags) for _, tags in windows], dtype=np.int64)


class Scorer:
    """The field, and a logistic function of a document's marginals."""

    def __init__(self, field: Field | None, weights: np.ndarray):
        self.field, self.weights = field, weights

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        """Score of each text, and the offsets (in code points) of its toxic spans."""
        if self.field is None:
            return np.full(len(texts), _logistic(self.weights[0])), [[] for _ in texts]
        rows, spans = np.zeros((len(texts), 4)), [[] for _ in texts]
        words = [_WORD.findall(t) for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(words) else np.empty(0, np.int64)
        scores = self.field.word_scores([w for ws in words for w in ws])
        used = np.flatnonzero(lengths)
        p = self.field.marginals(scores, starts[used], lengths[used])
        for i in used:
            own = p[starts[i] : starts[i] + lengths[i]]
            rows[i] = document_row(own)
            if own.max() >= 0.5:
                spans[i] = _spans(texts[i], own)
        rows[:, 0] = 1
        return _logistic(rows @ self.weights), spans


def document_row(p: np.ndarray) -> np.ndarray:
    total = float(p.sum())
    return np.array([1.0, np.log1p(total), float(p.max()), np.log1p(1000 * total / len(p))])


def _spans(text: str, p: np.ndarray) -> list[dict]:
    out: list[dict] = []
    for i, m in enumerate(_WORD.finditer(text)):
        if p[i] >= 0.5:
            if out and out[-1]["word"] == i - 1:
                out[-1] |= {"stop": m.end(), "word": i}
            else:
                out.append({"start": m.start(), "stop": m.end(), "word": i})
    return [{"start": s["start"], "stop": s["stop"]} for s in out]


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, toxic_share: float) -> Scorer:
    """Scorer from labelled texts; toxic_share is that of all labelled rows, which the sample's classes are weighted to.

    Without labels, or with one class only, every score is the (smoothed) share.
    """
    toxic_share = float(np.clip(toxic_share, 1e-3, 1 - 1e-3))
    flat = np.array([np.log(toxic_share / (1 - toxic_share)), 0, 0, 0])
    if not len(labels) or labels.min() == labels.max():
        return Scorer(None, flat)
    own = distinct_rows(texts)
    texts, labels = [texts[i] for i in own], labels[own]
    if labels.min() == labels.max():
        return Scorer(None, flat)
    words, states, sizes = _windows(texts, labels, marks(texts, labels))
    if not states.any():
        return Scorer(None, flat)
    field = fit_field(words, states, sizes)
    lists = [_WORD.findall(t) for t in texts]
    lengths = np.array([len(w) for w in lists])
    p = field.marginals(field.word_scores([w for ws in lists for w in ws]), np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0], lengths[lengths > 0])
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    x = np.array([document_row(p[cuts[i] : cuts[i + 1]]) if lengths[i] else [1.0, 0, 0, 0] for i in range(len(lists))])
    each = np.where(labels == 1, toxic_share / max(1, (labels == 1).sum()), (1 - toxic_share) / max(1, (labels == 0).sum()))
    w = flat.copy()
    for _ in range(60):  # Newton's method with a ridge
        q = _logistic(x @ w)
        ridge = 1e-4 * np.array([0.01, 1, 1, 1])
        grad = x.T @ (each * (labels - q)) - ridge * w
        step = np.linalg.solve((x * (each * q * (1 - q))[:, None]).T @ x + np.diag(ridge + 1e-9), grad)
        w = w + step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return Scorer(field, w)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of a bounded sample of the rows that may be learned from, and the share of toxic ones of all.

    Of texts that share an id the least one stands for it, so the sample has TOXIC_ROWS + CLEAN_ROWS texts at most.
    """
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") != 0).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = None
    for label, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        drawn = part if drawn is None else drawn.union(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(drawn), "id").select("id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("id", "toxic").agg(F.min("text").alias("text"))
    found = sorted(rows.collect(), key=lambda r: (r.id, r.text))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return [r.text for r in found], np.array([r.toxic for r in found], dtype=np.int64), share


def scored(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (array of start, stop) of every row of docs (doc_id, text).

    Only the text enters the score. Null and empty texts have no words and get the score of that. Null doc_ids are not
    held out. Repeated rows are each scored; an empty table gives an empty result; other columns are ignored.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                score, spans = scorer.documents([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(spans, span)], ["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,stop:int>>")
    return found.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "spans",
    )


def query(spark, sf_dir):
    """op1: toxicity of every document."""
    from quaver.llm.common import table

    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return scored(docs, fit(*sample(docs, labels)))
