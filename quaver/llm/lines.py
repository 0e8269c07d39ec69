"""Near-duplicate lines by MinHash over character shingles. DataFrame functions only.

1. *Signatures.* Every line gives a MinHash signature of its character shingles; equal lines have equal ones and are one
   row from here on, without their text.
2. *Bands.* Lines whose signatures agree in a band are candidates. In each band a line is compared with the band's
   first line and with the one before it; texts are fetched for lines that share a band only.
3. *Verification.* A pair is refused by sketches that bound how far two shingle sets differ; what is left is compared by
   the whole sets. Links that pass are joined by distributed union-find.
4. *What is left of large bands.* Bands that are then still in several components are compared between components:
   whole where few lines are left, by a prefix filter, which loses no pair, where many are.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.llm.common import discard, materialize
from quaver.llm.components import connected_components

#: Characters of a shingle, minima that make a signature, and the Jaccard similarity of duplicates.
SHINGLE, MINIMA, SIMILAR = 8, 8, 0.8
#: Each band takes the minima at these places from its own on, round the signature.
BAND = (0, 1, 4)
#: Lines of up to so many shingles have so many signatures: the minima of a small set depend on each other.
SHORT, SIGNATURES = 24, 3
#: Hashes of a line that are expected to stay candidates for its minima (the larger ones cannot well be least), and
#: shingles that are looked at to tell whether a line repeats itself.
KEPT, PROBES = 32, 32
#: Longs of a sketch, and how many of them a row holds while they are gathered.
SKETCH, GATHERED = 32, 8
#: Bands of up to this many lines are compared whole by the first round; of those left, these many are by the second.
SMALL_BAND, WHOLE_BAND = 3, 256
#: A table of hashes (and counts) up to this many rows is broadcast (under 64 MB); beyond, the join is a shuffle.
BROADCAST_ROWS = 1_000_000
#: Characters that a blank line consists of.
BLANK = " \t\n\x0b\x0c\r"


def _units(line: Column) -> Column:
    """The characters of a line, two bytes each (four beyond the basic plane, which count as two)."""
    return F.encode(line, "UTF-16BE")


def _shingle_starts(units: Column) -> Column:
    """Places of the shingles of a line in _units(): every character that SHINGLE characters begin at; else the first."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(units) - (2 * SHINGLE - 1), F.lit(1)), F.lit(2))


def _shingle_count(units: Column) -> Column:
    """How many places _shingle_starts() gives."""
    return F.greatest(F.shiftright(F.octet_length(units), 1) - (SHINGLE - 1), F.lit(1))


def _shingle_hash(units: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(units, start, F.lit(2 * SHINGLE)))


def _hashes_at(units: Column, items: Callable[[Column], Column], place: Callable[[Column], Column] = lambda x: x) -> Column:
    """Hashes of the shingles at the place of each of the items of _units(), as an array.

    Lambdas are not compiled, and one that takes a line from a column copies it each time: so units are an argument of one.
    """
    return F.get(F.transform(F.array(units), lambda u: F.transform(items(u), lambda x: _shingle_hash(u, place(x)))), F.lit(0))


def shingle_hashes(line: Column) -> Column:
    """Hashes of all strings of SHINGLE characters of a line, repeats included; of the whole line, if it is shorter."""
    return _hashes_at(_units(line), _shingle_starts)


def _limit(units: Column, shingles: Column) -> Column:
    """Below this stays a hash, behind its leading bits, a candidate for its line's minima: KEPT hashes are expected to.

    Short lines keep all hashes, and so do lines that repeat themselves, as PROBES shingles drawn from all over them show.
    """
    room = 1 << (64 - (MINIMA - 1).bit_length())
    rng = random.Random(1)  # any numbers will do that keep no step with a period
    shares = F.array(*[F.lit((k + rng.random()) / PROBES) for k in range(PROBES)])
    probes = _hashes_at(units, lambda _: shares, lambda share: 2 * (share * shingles).cast("int") + 1)
    few = F.when(shingles <= 4 * KEPT, True).otherwise(F.size(F.array_distinct(probes)) < PROBES - 1)
    return F.when(few, F.lit(room)).otherwise((F.lit(float(room) * KEPT) / shingles).cast("long"))


def signatures(lines: DataFrame) -> DataFrame:
    """(h, family, copies, m0, m1, ...) of lines (h, line): a row for each distinct line and family of hashes.

    The minima are those of MINIMA anchors: the least hash as to the bits that differ from the anchor's. Anchors have
    leading bits of their own, so each minimum is that of a permutation of its own. Lines of up to SHORT shingles have
    SIGNATURES families. Of long lines a hash enters if it is small behind its leading bits, as the least ones are (the
    first shingle always does). Shingles are rows that are aggregated before anything is shuffled; no text is shuffled.
    """
    units = lines.select("h", _units(F.col("line")).alias("units")).withColumn("shingles", _shingle_count(F.col("units")))
    units = units.select("h", "units", _limit(F.col("units"), F.col("shingles")).alias("limit"), F.when(F.col("shingles") <= SHORT, SIGNATURES - 1).otherwise(0).alias("last"))
    units = units.select("h", "units", "limit", F.explode(F.sequence(F.lit(0), "last")).alias("family"))
    starts = units.select("h", "family", "units", "limit", F.explode(_shingle_starts(F.col("units"))).alias("start"))
    of = F.xxhash64(F.substring("units", F.col("start"), F.lit(2 * SHINGLE)), "family")
    hashes = starts.select("h", "family", "limit", (F.col("start") == 1).alias("first"), of.alias("s"))
    bits = (MINIMA - 1).bit_length()
    hashes = hashes.where(F.col("first") | (F.shiftrightunsigned(F.shiftleft("s", bits), bits) < F.col("limit")))
    step = (1 << 64) // MINIMA
    minima = [F.min(F.col("s").bitwiseXOR(F.lit(i * step - (1 << 63)))).alias(f"m{i}") for i in range(MINIMA)]
    return hashes.groupBy("h", "family").agg(F.sum(F.col("first").cast("int")).alias("copies"), *minima)


def bands() -> Column:
    """Keys of the MINIMA bands of a signature. Of lines that are SIMILAR, 0.96 or more share one (measured in the tests)."""
    places = [[(i + j) % MINIMA for j in BAND] for i in range(MINIMA)]
    return F.array(*[F.xxhash64(F.col("family") * MINIMA + i, *[F.col(f"m{j}") for j in band]) for i, band in enumerate(places)])


def lines_of(docs: DataFrame) -> DataFrame:
    """(h, line) of every line that is not blank. Lines are set apart by line feeds."""
    rows = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    return rows.where(~_blank(F.col("line"))).select(F.xxhash64("line").alias("h"), "line")


def _blank(line: Column) -> Column:
    return (line < "!") & (F.btrim(line, F.lit(BLANK)) == "")


def text_id() -> Column:
    """What tells rows with one doc_id, or with none, apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def band_places(lines: DataFrame) -> DataFrame:
    """(key, h, n, back, head) of every distinct line of lines (h, line) in every band that n > 1 lines share.

    A band's lines are in the order of their copies, the most first: back is the line before, head the first one.
    """
    keyed = signatures(lines).select(F.explode(bands()).alias("key"), "h", "copies")
    band = W.partitionBy("key").orderBy(F.desc("copies"), "h")
    whole = band.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = keyed.select("key", "h", F.count(F.lit(1)).over(whole).alias("n"), F.lag("h").over(band).alias("back"), F.first("h").over(whole).alias("head"))
    return found.where("n > 1")


def first_pairs(places: DataFrame) -> DataFrame:
    """(a, b): every line of a band with the band's first and with the one before it.

    These are all pairs of a SMALL_BAND, and a number in proportion to the lines of larger ones.
    """
    near = places.where("back is not null").select("h", F.explode(F.array_distinct(F.array("back", "head"))).alias("other"))
    return near.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()


def texts_of(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """(h, line, size, bits) of the lines (h, line) whose h is among the distinct hashes (h).

    bits is a sketch: each shingle sets one of 64 * SKETCH bits, so two sketches differ in no more bits than there are
    shingles that one line has and the other has not. size is the number of places of shingles.
    """
    few = hashes.count() <= BROADCAST_ROWS
    found = lines.join(F.broadcast(hashes) if few else hashes, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    found = materialize(found, "line-texts")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the lines are few bytes but much work
    apart = found.repartition(parts, "h")  # what follows stays in the partition that holds the line
    units = apart.select("h", _units(F.col("line")).alias("units"))
    starts = units.select("h", "units", F.explode(_shingle_starts(F.col("units"))).alias("start"))
    hashed = starts.select("h", _shingle_hash(F.col("units"), F.col("start")).alias("s"))
    sides, bit = SKETCH // GATHERED, F.expr("shiftleft(1L, cast(s & 63 as int))")
    word = F.shiftrightunsigned("s", 6).bitwiseAND(F.lit(GATHERED - 1))
    side = F.shiftrightunsigned("s", 58).bitwiseAND(F.lit(sides - 1))
    marked = hashed.select("h", side.alias("side"), word.alias("word"), bit.alias("bit"))
    zero = F.lit(0).cast("long")
    marked = marked.groupBy("h", "side").agg(F.count(F.lit(1)).alias("places"), *[F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(zero)).alias(f"w{i}") for i in range(GATHERED)])
    marked = marked.select("h", "side", "places", F.array(*[F.col(f"w{i}") for i in range(GATHERED)]).alias("bits"))
    none = F.array(*[zero] * GATHERED)
    of = [F.coalesce(F.max(F.when(F.col("side") == i, F.col("bits"))), none) for i in range(sides)]
    sketches = marked.groupBy("h").agg(F.sum("places").cast("int").alias("size"), F.concat(*of).alias("bits"))
    whole = materialize(apart.join(sketches, "h"), "line-sketches")
    discard(found)
    return whole


def folded() -> Column:
    """A sketch in half the longs. More of them make a join's code so long that it is not compiled."""
    return F.array(*[F.get("bits", F.lit(i)).bitwiseOR(F.get("bits", F.lit(i + SKETCH // 2))) for i in range(SKETCH // 2)]).alias("bits")


def _may_be_similar(longs: int = SKETCH // 2) -> Column:
    """Whether sizes and sketches of two lines a and b allow that they are SIMILAR: false only if they are not.

    Sets of a similarity of t differ in at most (1 - t) / (1 + t) of the sum of their sizes.
    """
    sizes = F.col("size_a") + F.col("size_b")
    differ = [F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(longs)]
    return sum(differ, F.lit(0)) <= F.lit((1 - SIMILAR) / (1 + SIMILAR) + 1e-9) * sizes


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole shingle sets have a Jaccard similarity of SIMILAR or more. texts: as texts_of()."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(*[F.col(c).alias(side if c == "h" else f"{c}_{side}") for c in ("h", "line", "size", "bits")]), side)
    pairs = pairs.where(_may_be_similar(SKETCH))
    pairs = pairs.select("a", "b", shingle_hashes(F.col("line_a")).alias("one"), shingle_hashes(F.col("line_b")).alias("two"))
    # Both of these drop repeats, in compiled code, which the lambda above is not.
    pairs = pairs.select("a", "b", F.size(F.array_intersect("one", "two")).alias("shared"), F.size(F.array_union("one", "two")).alias("all"))
    return pairs.where(F.col("shared") >= SIMILAR * F.col("all")).select("a", "b")


def unsettled(places: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, h, root, left) of the lines of bands that first_pairs() did not compare whole and that hold several components.

    left is the number of such lines of the band.
    """
    large = places.where(f"n > {SMALL_BAND}").select("key", "h")
    rooted = large.join(roots, large.h == roots.node, "left").select("key", "h", F.coalesce("root", "h").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("left"))
    return rooted.join(split.where("low <> high").select("key", "left"), "key").select("key", "h", "root", "left")


def whole_band_pairs(left: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): pairs of different components, within bands that unsettled() has up to WHOLE_BAND lines of, as sketches allow."""
    few = left.where(f"left <= {WHOLE_BAND}").join(texts.select("h", "size", folded()), "h")
    one, two = (few.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("h", "root", "size", "bits")]) for side in "ab")
    met = one.join(two, (one.key == two.key) & (F.col("h_a") < F.col("h_b")) & (F.col("root_a") != F.col("root_b")) & _may_be_similar())
    return met.select(F.col("h_a").alias("a"), F.col("h_b").alias("b")).distinct()


def prefix_pairs(lines: DataFrame) -> DataFrame:
    """(a, b): every pair of lines (h, root, line, size, bits) of different roots that may be SIMILAR; none that is gets lost.

    With all shingles in one order, the rarest first, two sets of a Jaccard similarity of t share a shingle among the
    first n - ceil(t n) + 1 of each. Only those few are joined, and shingles that one line alone has drop out. At the
    first shingle shared, the sizes and what is left behind it must allow the overlap that t asks for, and so must the
    sketches. Counts are aggregated before they are shuffled; a line's shingles stay in the partition that holds the
    line. Joins are by shingle, and adaptive execution splits their large partitions. Shingles are told apart by 48 bits
    of their hash, under 15 bits of their count: a clash gives a candidate more.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the lines are few bytes but much work
    units = lines.repartition(parts, "h").select("h", "root", _units(F.col("line")).alias("units"))
    starts = units.select("h", "root", "units", F.explode(_shingle_starts(F.col("units"))).alias("start"))
    hashed = _shingle_hash(F.col("units"), F.col("start")).bitwiseAND(F.lit((1 << 48) - 1))
    sets = starts.select("h", "root", hashed.alias("s")).groupBy("h", "root", "s").agg(F.lit(1).alias("one")).select("h", "root", "s")
    common = sets.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = materialize(common.select(F.col("s").alias("of"), F.least("n", F.lit((1 << 15) - 1)).alias("n")), "common-shingles")
    few = common.count() <= BROADCAST_ROWS
    counted = sets.join(F.broadcast(common) if few else common, F.col("s") == F.col("of"), "left")
    placed = F.shiftleft(F.coalesce("n", F.lit(1)), 48).bitwiseOR(F.col("s"))
    ordered = counted.groupBy("h", "root").agg(F.sort_array(F.collect_list(placed)).alias("set"))
    # A hair less than t, so that no rounding shortens a prefix or raises a bound.
    least = SIMILAR - 1e-9
    ordered = ordered.withColumn("least_shared", F.ceil(F.size("set") * F.lit(least)).cast("int"))
    first = ordered.select("h", "root", F.size("set").alias("own"), F.posexplode(F.expr("slice(set, 1, 1 + size(set) - least_shared)")).alias("at", "s"))
    first = first.where(F.col("s") >= F.lit(2 << 48)).join(lines.select("h", "size", folded()), "h")
    first = materialize(first, "line-prefixes")
    one, two = (first.select("s", *[F.col(c).alias(f"{c}_{side}") for c in ("h", "root", "own", "at", "size", "bits")]) for side in "ab")
    most = F.least(F.col("own_a") - F.col("at_a"), F.col("own_b") - F.col("at_b"))
    fits = most >= F.lit(least / (1 + least)) * (F.col("own_a") + F.col("own_b"))
    met = one.join(two, (one.s == two.s) & (F.col("h_a") < F.col("h_b")) & (F.col("root_a") != F.col("root_b")) & fits & _may_be_similar())
    met = materialize(met.select(F.col("h_a").alias("a"), F.col("h_b").alias("b")).distinct(), "line-prefix-pairs")
    discard(first)
    discard(common)
    return met


def late_pairs(left: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): pairs of different components of unsettled() that may be SIMILAR. None that is, of one band, is lost."""
    many = left.where(f"left > {WHOLE_BAND}").groupBy("h").agg(F.min("root").alias("root"))
    return whole_band_pairs(left, texts).union(prefix_pairs(many.join(texts, "h"))).distinct()


def similar_links(lines: DataFrame) -> DataFrame:
    """(a, b) hashes of lines (h, line): links between the same lines, over steps, as the pairs that are SIMILAR make.

    Candidates share a band. Small bands are compared whole. In larger ones each line is compared with two others first,
    which joins most of what is alike in work that grows with the lines; pairs between the components that a band is
    then left with are all compared, by late_pairs().
    """
    places = materialize(band_places(lines), "line-bands")
    texts = texts_of(lines, places.select("h").distinct())
    roots = materialize(connected_components(similar_pairs(first_pairs(places), texts)), "line-roots")
    left = materialize(unsettled(places, roots), "lines-unsettled")
    late = similar_pairs(late_pairs(left, texts), texts)
    links = materialize(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late), "line-links")
    for done in (places, texts, roots, left):
        discard(done)
    return links


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text_id, hashes) of every row of docs: the hash of each line, null for blank ones.

    doc is a struct that orders documents by id, those without one last.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    hashes = F.transform(F.split(text, "\n"), lambda x: F.when(~_blank(x), F.xxhash64(x)))
    return docs.select(id_.alias("doc_id"), F.struct(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0).cast("long")).alias("id")).alias("doc"), text_id().alias("text_id"), hashes.alias("hashes"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (sorted numbers from 0) of every row of docs (doc_id, text).

    Lines that are equal or SIMILAR, over steps as well, are one component; the line that stays is the component's first
    by doc_id and line number. Lines of white space only are no lines here and always stay. Null texts have no lines;
    null doc_ids come after all others. Different texts under one id, or under none, are documents of their own, in the
    order of their hashes; rows with equal ids and texts are one document, and each is returned. An empty table gives an
    empty result; other columns are ignored. Lines, and texts of one id, are told apart by a 64-bit hash.
    """
    return _removed(docs).drop("text_id")


def _removed(docs: DataFrame) -> DataFrame:
    """Rows of repeated_lines(), with the text_id() of each."""
    links = similar_links(lines_of(docs))
    roots = materialize(connected_components(links), "line-classes")
    discard(links)
    rows = materialize(line_hashes(docs), "line-hashes")
    places = rows.select("doc", "text_id", F.posexplode("hashes").alias("line_no", "h")).where("h is not null")
    more = places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    named = more.join(roots, more.h == roots.node, "full").select(F.coalesce("h", "node").alias("h"), F.coalesce("root", "h").alias("root"))
    hits = materialize(places.join(named, "h").select("root", F.struct("doc", "text_id", "line_no").alias("place")), "line-hits")
    keep = hits.groupBy("root").agg(F.min("place").alias("keep"))
    gone = hits.join(keep, "root").where("place <> keep").select("place.*")
    gone = materialize(gone.groupBy("doc", "text_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines")), "lines-gone")
    discard(hits)
    discard(roots)
    lines = F.size(F.filter("hashes", lambda h: h.isNotNull())).cast("long")
    found = rows.select("doc_id", "doc", "text_id", lines.alias("n_lines")).join(gone, ["doc", "text_id"], "left")
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return found.select("doc_id", "text_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that repeated_lines() names cut from column text; all rows and columns stay."""
    found = _removed(docs).where("n_removed > 0").select(F.col("doc_id").alias("gone_from"), F.col("text_id").alias("gone_text"), "removed_lines")
    found = found.dropDuplicates(["gone_from", "gone_text"])
    names = docs.columns
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("kept")
    rows = docs.select(kept, F.col("doc_id").cast("long").alias("id"), text_id().alias("of_text"))
    text = F.col(f"kept.c{names.index('text')}")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("removed_lines", i)), "\n")
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("gone_from")) & (F.col("of_text") == F.col("gone_text")), "left")
    return rows.select(*[(F.when(F.col("removed_lines").isNull(), text).otherwise(left) if c == "text" else F.col(f"kept.c{i}")).alias(c) for i, c in enumerate(names)])


def query(spark, sf_dir):
    """op10: which lines of every document go."""
    from quaver.llm.common import table

    return repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
