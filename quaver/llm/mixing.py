"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.llm.common import discard, materialize, word_count

#: Weights of the sources in order of their names, repeating; no document is taken more often than CAP.
WEIGHTS, CAP = (5, 2, 1), 3
#: Bits of a histogram's bucket, and how many histograms refine one threshold.
BITS, LEVELS = 12, 3
#: Sources up to this many are broadcast; beyond, the join is by salted source.
BROADCAST_SOURCES, SALTS = 100_000, 32
#: Budgets that are met one after another: what the first threshold leaves is met by documents that fit into it, and
#: what these leave by further copies of documents that fit.
NESTED, EXTRA = 3, 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(skey, source, source_size, target, full, rest) of each source of sizes (source, size).

    The sources in code point order, null last, weigh as ``weights`` say, repeating. Targets share the sum of all sizes
    by weight; none is over ``cap`` times its source's size, and what that leaves is shared by weight among the others.
    In ascending order of size to weight a source is capped as long as its share, after all before it were capped, is
    not below its cap: the fixed point of sharing again and again, in one pass over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(choices, (F.row_number().over(by_name) - 1) % len(weights)))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left).withColumn("capped", F.col("level") >= F.col("ratio"))
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * shared)
    per = per.withColumn("target", target)
    full = F.when(F.col("capped"), F.lit(cap)).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per = per.withColumn("full", full.cast("int"))
    return per.select(
        _key(F.col("source")).alias("skey"), "source", "source_size", "target", "full",
        F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size")).alias("rest"),
    )


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source))


def _with_source(rows: DataFrame, state: DataFrame, sources: int) -> DataFrame:
    """Adds the state of its source to each row. One row a source is broadcast if that is proven small, else salted."""
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(state), "skey")
    salted = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).join(salted, ["skey", "salt"]).drop("salt")


def _threshold(rows: DataFrame, budget: DataFrame, sources: int) -> DataFrame:
    """(skey, edge, left) from rows (skey, u, size) and budget (skey, left): rows with u < edge sum up to at most left.

    One histogram of the sizes by source and leading bits of the hash finds the bucket where the budget ends; the next
    histogram is over that bucket's rows alone, by the next bits. Each has 2**BITS buckets a source at most.
    """
    state = budget.select("skey", F.lit(0).cast("long").alias("edge"), "left")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = _with_source(rows, state, sources).where(
            F.shiftright(F.col("u"), shift + BITS) == F.shiftright(F.col("edge"), shift + BITS)
        )
        bars = inside.groupBy("skey", F.shiftright("u", shift).alias("bar")).agg(F.sum("size").alias("bar_size"))
        upto = W.partitionBy("skey").orderBy("bar").rowsBetween(W.unboundedPreceding, W.currentRow)
        run = bars.withColumn("run", F.sum("bar_size").over(upto)).join(F.broadcast(state) if sources <= BROADCAST_SOURCES else state, "skey")
        # The first bar that goes over; without one the threshold is above the bars.
        over = run.groupBy("skey").agg(
            F.min(F.when(F.col("run") > F.col("left"), F.col("bar"))).alias("bar"),
            F.max(F.when(F.col("run") <= F.col("left"), F.col("run"))).alias("spent"),
            F.max("bar").alias("last"),
        )
        state = state.join(over, "skey", "left").select(
            "skey",
            F.when(F.col("last").isNull(), F.col("edge"))
            .otherwise(F.shiftleft(F.coalesce(F.col("bar"), F.col("last") + 1), shift))
            .alias("edge"),
            (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"),
        )
        before, state = state, materialize(state, "threshold")
        discard(before)
    return state


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (and the columns of keep as kept_0, ...) of every row of docs.

    A document's size is its number of words (null text: 0). Of each source the mix takes every document
    floor(target / source size) times, and once more those whose hash of doc_id and size is under a threshold.
    Thresholds are nested: what the first one leaves of the budget is filled by documents that fit in it and lie above
    it, and so on; then by further copies, up to ``cap``; at the end the smallest document that brings a source nearer
    goes in. Only hash and size decide, so reruns agree, rows that repeat an id and a size go together, and nothing is
    sorted. A null source is a source of
    its own, the last; sources without words have target 0. An empty table gives an empty result.
    """
    digest = F.xxhash64(F.lit("mix"), F.col("doc_id").cast("string"), F.col("size"))
    sized = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *[F.col(f"`{k}`").alias(f"kept_{i}") for i, k in enumerate(keep)]).alias("r"), word_count(F.col("text").cast("string")).alias("size"))
    sized = sized.select("r.*", "size", _key(F.col("r.source")).alias("skey"))
    sized = materialize(sized.withColumn("u", F.shiftrightunsigned(digest, 64 - BITS * LEVELS)), "sizes")
    targets = materialize(source_targets(sized.select("source", "size"), weights, cap), "targets")
    sources = targets.count()
    rows = sized.select("skey", "u", "size").where("size > 0")

    edges = targets.select("skey", "full", F.col("rest").alias("left"))
    for i in range(NESTED + EXTRA):
        copies = F.col("full") + _copies(i)
        room = F.lit(cap) > copies
        once = ~_once(i) if i < NESTED else F.lit(True)
        fits = _with_source(rows, edges, sources).where(room & once & (F.col("size") <= F.col("left"))).select("skey", "u", "size")
        met = _threshold(fits, edges.select("skey", "left"), sources)
        found = met.select("skey", F.col("edge").alias(f"edge{i}"), F.col("left").alias("next"))
        before, edges = edges, materialize(edges.join(found, "skey").withColumnRenamed("left", f"left{i}").withColumnRenamed("next", "left"), "edges")
        discard(before)
        discard(met)
    near = _with_source(rows, edges, sources).where((F.lit(cap) > F.col("full") + _copies(NESTED + EXTRA)) & (F.col("size") < 2 * F.col("left")))
    last = near.groupBy("skey").agg(F.min(F.struct("size", "u")).alias("last"))
    state = targets.drop("source", "full").join(edges.join(last, "skey", "left"), "skey")
    whole = _with_source(sized, state, sources)
    more = F.coalesce((F.col("last.size") == F.col("size")) & (F.col("last.u") == F.col("u")), F.lit(False)).cast("int")
    times = F.col("full") + F.when(F.col("rest") > 0, _copies(NESTED + EXTRA) + more).otherwise(0)
    return whole.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"),
        *[f"kept_{i}" for i in range(len(keep))],
    )


def _once(passes: int) -> Column:
    """Whether one of the first passes has taken the row once more."""
    taken = F.lit(False)
    for k in range(min(passes, NESTED)):
        taken = taken | _under(k)
    return taken


def _copies(passes: int) -> Column:
    """How often the passes so far have taken the row, beside the full rounds."""
    count = _once(passes).cast("int")
    for k in range(NESTED, passes):
        count = count + _under(k).cast("int")
    return count


def _under(k: int) -> Column:
    return (F.col("u") < F.col(f"edge{k}")) & (F.col("size") <= F.col(f"left{k}"))


def mixture(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs (doc_id, source, text and any other columns) as the mix takes them: a document taken twice is two rows."""
    names = docs.columns
    found = mixed(docs, weights, cap, keep=tuple(names)).where("taken > 0")
    times = F.expr("sequence(1L, taken div size)")
    return found.select(*[F.col(f"kept_{i}") for i in range(len(names))], F.explode(times)).select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)])


def query(spark, sf_dir):
    """op3: what the mix takes of every document."""
    from quaver.llm.common import table

    found = mixed(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")
