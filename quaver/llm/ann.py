"""Nearest neighbours by largest inner product with an inverted multi-index."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.llm.common import materialize

#: The index is fitted on this many vectors at most; every vector is indexed.
FIT_ROWS, PILOT_QUERIES = 8192, 256
#: Wanted entries of a cell, centroids of a half, rows of a block, and queries that a block's copy serves and compares at once.
CELL_ROWS, MAX_CENTROIDS, BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 48, 128, 16384, 32768, 256
#: Recall that the share of entries to visit is fitted for on the pilot queries.
PILOT_RECALL = 0.96


class MultiIndex:
    """Centroids of two vector halves, and how much of the entries, nearest cells first, a query visits."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, seed: int = 7):
        self.split = sample.shape[1] // 2 or 1
        wanted = int(np.clip(round(np.sqrt(rows / CELL_ROWS)), 1, MAX_CENTROIDS))
        rng = np.random.default_rng(seed)
        self.centroids = [_kmeans(h, min(wanted, len(sample)), rng) for h in self._halves(sample)]
        self.share = self._visit_share(sample, k, rng)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.split], x[:, self.split :]

    @property
    def cells(self) -> int:
        return len(self.centroids[0]) * len(self.centroids[1])

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = (_nearest(h, c) for h, c in zip(self._halves(x), self.centroids, strict=True))
        return a * len(self.centroids[1]) + b

    def visited(self, query: np.ndarray, counts: np.ndarray, wanted: float):
        """Cells by ascending sum of the distances of the query's halves to the centroid pair, until wanted entries."""
        first, second = (_distances(h[None], c)[0] for h, c in zip((query[: self.split], query[self.split :]), self.centroids, strict=True))
        one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        width, seen = len(two), 0
        heap = [(first[one[0]] + second[two[0]], 0, 0)]
        while heap and seen < wanted:
            _, i, j = heapq.heappop(heap)
            cell = one[i] * width + two[j]
            yield cell
            seen += counts[cell]
            if j + 1 < width:
                heapq.heappush(heap, (first[one[i]] + second[two[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (first[one[i + 1]] + second[two[0]], i + 1, 0))

    def _visit_share(self, sample: np.ndarray, k: int, rng) -> float:
        """Share of the sample that pilot queries must visit for PILOT_RECALL of their k nearest.

        In the sample neighbours are sparser, so farther, than among all rows: the share errs on the safe side.
        """
        if len(sample) < 4 * k:
            return 1.0
        counts = np.bincount(self.cell(sample), minlength=self.cells)
        home, depths = self.cell(sample), []
        for i in rng.choice(len(sample), min(PILOT_QUERIES, len(sample)), replace=False):
            score = sample @ sample[i]
            score[i] = -np.inf
            order = np.fromiter(self.visited(sample[i], counts, len(sample) + 1), dtype=np.int64)
            depth = np.empty(self.cells)
            depth[order] = np.cumsum(counts[order])
            depths.append(depth[home[np.argpartition(-score, k)[:k]]])
        return float(min(1.0, np.quantile(np.concatenate(depths), PILOT_RECALL) / len(sample) + 1e-9))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1)[None] - 2 * x @ c.T + (x * x).sum(1)[:, None]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _distances(x, c).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(x, centroids)
        size = np.bincount(home, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    return centroids


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of rows with an id and a vector that is finite, not null and not zero."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where("vec_id is not null and v is not null").where(~F.coalesce(bad, F.lit(True))).where(F.exists("v", lambda x: x != 0))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each distinct vector with its smallest ids, as many as can matter. Batches go together before the shuffle."""

    def thin(frames):
        for f in frames:
            f = f.assign(k=[np.asarray(x).tobytes() for x in f["v"]]).drop_duplicates(["k", "vec_id"]).sort_values("vec_id")
            f = f[f.groupby("k").cumcount() < keep]
            yield f[["v"]].assign(ids=[[i] for i in f["vec_id"]])

    thinned = rows.mapInPandas(thin, "v array<double>, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return thinned.groupBy("v").agg(ids.alias("ids"))


def nearest(vectors: DataFrame, k: int = 20, is_query=None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query by largest inner product.

    vectors: vec_id, embedding. Queries are the rows for which ``is_query`` holds (vec_id divisible by 20 if None);
    candidates are all rows but the query's own. Scores are inner products of the original vectors in double precision;
    ties go to the smaller vec_id. Rows without an id, and vectors that are null, zero, or hold null or non-finite
    components take no part, nor do vectors that are not as long as most. Rows that repeat an id and a vector count once.
    With fewer candidates than k all are returned; an empty table gives an empty result; other columns are ignored.

    Equal vectors are one entry that keeps its k + 1 smallest ids (more can't be among k), and equal queries are searched
    once. Entries are dealt to blocks of whole cells, large cells to several, and a query is sent to each block in which
    it visits a cell; blocks keep the k + 1 best of each query. A block is copied once for BLOCK_QUERIES of all queries,
    so what is sent grows with entries and with queries visited, not with the square of the table, up to there.
    """
    is_query = (F.col("vec_id") % 20 == 0) if is_query is None else is_query
    rows = _usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows = rows.where(F.size("v") == sizes.n)
    entries = materialize(_classes(rows, k + 1), "entries")
    total = entries.count()
    drawn = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(FIT_ROWS)
    index = MultiIndex(np.array([r.v for r in drawn.collect()]), total, k)

    def place(frames):
        for f in frames:
            if len(f):
                yield f.assign(cell=index.cell(np.stack(f["v"])).astype("int32"))

    placed = materialize(entries.mapInPandas(place, "v array<double>, ids array<long>, cell int"), "cells")
    counts = np.zeros(index.cells, dtype=np.int64)
    for r in placed.groupBy("cell").count().collect():  # one row a cell: MAX_CENTROIDS ** 2 at most
        counts[r.cell] = r["count"]
    first, parts = _blocks(counts)
    wanted = index.share * total

    asked = rows.where(is_query).groupBy("v").agg(F.min("vec_id").alias("query"))
    asked = materialize(asked, "queries")
    salts = max(1, -(-asked.count() // BLOCK_QUERIES))
    parts_asked = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)

    def probe(frames):
        for f in frames:
            out = {"block": [], "query": [], "v": [], "cells": []}
            for query, v in zip(f["query"], f["v"], strict=True):
                at: dict[int, list[int]] = {}
                for cell in index.visited(np.asarray(v), counts, wanted):
                    if counts[cell]:
                        for b in range(first[cell], first[cell] + parts[cell]):
                            at.setdefault(int(b), []).append(int(cell))
                for block, cells in at.items():
                    for name, value in zip(out, (block, query, v, cells), strict=True):
                        out[name].append(value)
            yield pd.DataFrame(out)

    def dealt(frames):
        for f in frames:
            if len(f):
                cell = f["cell"].to_numpy()
                spread = np.array([i[0] for i in f["ids"]]) * 0x9E3779B1 % (1 << 32) % parts[cell]
                yield f.assign(block=first[cell] + spread)

    # A query is few bytes, but its walk over the cells is work: dealt out, whatever the files are.
    probes = asked.repartition(parts_asked, "query").mapInPandas(probe, "block long, query long, v array<double>, cells array<int>")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(salts)).cast("int"))
    blocks = placed.mapInPandas(dealt, "v array<double>, ids array<long>, cell int, block long")
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def rerank(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "vec_id", "score"]
        if not len(queries) or not len(block):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in columns})
        x, cell = np.stack(block["v"]), block["cell"].to_numpy()
        names, at = np.unique(cell, return_inverse=True)
        ids, best, out = block["ids"].to_numpy(), min(k + 1, len(x)), []
        for start in range(0, len(queries), AT_ONCE):
            part = queries.iloc[start : start + AT_ONCE]
            q = np.stack(part["v"])
            seen = np.zeros((len(q), len(names)), dtype=bool)
            for i, cells in enumerate(part["cells"]):
                seen[i, np.searchsorted(names, np.intersect1d(cells, names))] = True
            score = np.where(seen[:, at], q @ x.T, -np.inf)
            floor = np.partition(score, len(x) - best, axis=1)[:, len(x) - best]
            for i, query in enumerate(part["query"]):
                hits = np.flatnonzero((score[i] >= floor[i] - 1e-12 * abs(floor[i])) & np.isfinite(score[i]))
                exact = (x[hits] * q[i]).sum(axis=1)
                found = sorted((-s, int(v)) for s, h in zip(exact, hits, strict=True) for v in ids[h])[: k + 1]
                out += [(query, v, -s) for s, v in found]
        return pd.DataFrame(out, columns=columns)

    found = (
        probes.groupBy("block", "salt").cogroup(blocks.groupBy("block", "salt"))
        .applyInPandas(rerank, "query long, vec_id long, score double")
    )
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col("at"), "vec_id", "score"))).alias("found"))
    every = rows.where(is_query).select("vec_id", "v").distinct().join(asked, "v").select(F.col("vec_id").alias("query_id"), "query")
    own = every.join(lists, "query").withColumn("found", F.filter("found", lambda x: x["vec_id"] != F.col("query_id")))
    ranked = own.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share a block, a large one is dealt over several."""
    first, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    block, held = 0, 0
    for cell, n in enumerate(counts):
        if n > BLOCK_ROWS:
            block += held > 0
            first[cell], parts[cell], held = block, -(-n // BLOCK_ROWS), 0
            block += parts[cell]
            continue
        if held + n > BLOCK_ROWS:
            block, held = block + 1, 0
        first[cell], held = block, held + n
    return first, parts


def query(spark, sf_dir):
    """op4: the 20 nearest vectors of every twentieth vector."""
    from quaver.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
