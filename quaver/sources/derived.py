"""Music relations derived from the driver's tables, which hold none: the same rule is stated as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: SQL of the relations below, for DuckDB.
SQL = {
    "notes": """select l_orderkey as phrase_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as seq,
        cast(14 + l_partkey % 100 as bigint) as midi from lineitem""",
    "tokens": """select l_orderkey as phrase_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as seq,
        substr('CDEFGAB', cast(1 + l_partkey % 7 as int), 1) as step, case l_suppkey % 3 when 0 then '' when 1 then '#' else 'b' end as acc,
        cast(l_linenumber as bigint) as octave, l_suppkey % 5 = 0 as twice from lineitem""",
    "pairs": """select l_orderkey as phrase_id,
        coalesce(string_agg(chr(cast(14 + l_partkey % 100 as int)), '' order by l_linenumber, l_partkey, l_suppkey), '') as truth,
        coalesce(string_agg(chr(cast(14 + (l_partkey + case when l_quantity >= 45 then 1 else 0 end) % 100 as int)), '' order by l_linenumber, l_partkey, l_suppkey)
            filter (where l_quantity >= 8), '') as read
        from lineitem group by l_orderkey""",
    "measures": """select o_custkey as read_id, 0 as part, row_number() over (partition by o_custkey order by o_orderkey) as measure,
        case when o_orderkey % 4 = 0 then cast(1 + o_orderkey % 3 as int) end as divisions,
        case when o_orderkey % 3 = 0 then cast(o_orderkey % 5 as int) end as beats,
        case when o_orderkey % 3 = 0 then 4 end as beat_type, coalesce(d.duration, 0) as duration
        from orders left join (select l_orderkey, cast(sum(case when l_returnflag = 'R' then 0 else 1 + l_linenumber % 3 end) as int) as duration
            from lineitem group by l_orderkey) d on o_orderkey = l_orderkey""",
    "heads": """select l_orderkey as read_id, cast(round(l_discount * 100) as bigint) * 8 + 15 as ctx, cast(round(l_tax * 100) as bigint) * 10 + 20 as grade
        from lineitem where l_linenumber % 4 <> 0""",
    "labeled": """select d.doc_id as read_id, (n_chars % 1000) / 1000e0 as mean_ctx, (d.doc_id % 5) / 4e0 as bad_frac, quality = 1 as should_accept
        from documents d join labels l on d.doc_id = l.doc_id""",
    "pixels": """select image_id, pos, cast(floor((e + 1) * 127.5) as int) as v from
        (select vec_id as image_id, unnest(range(1, len(embedding) + 1)) as pos, cast(unnest(embedding) as double) as e from embeddings)""",
    "marks": """select l_orderkey as staff, cast(floor(l_extendedprice / 5000) as bigint) as x, cast(l_quantity as int) % 19 - 5 as step, (l_partkey % 100) / 100e0 as fill,
        (l_partkey % 37 + 63) / 100e0 as core, (l_partkey % 31) / 10e0 as wide, (l_partkey % 23) / 10e0 as tall, l_partkey % 2 = 0 as stem from lineitem""",
    "runs": "select distinct user_id as grp, cast(floor(value) as bigint) as v from events",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.withColumn("seq", F.row_number().over(order).cast("long"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phrase_id, seq, midi): a phrase an order; MIDI numbers 14 to 113."""
    return _numbered(spark, sf_dir).select(F.col("l_orderkey").alias("phrase_id"), "seq", (14 + F.col("l_partkey") % 100).cast("long").alias("midi"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phrase_id, seq, step, acc, octave, twice): letters, accidentals and octaves from the keys of an order's lines."""
    step = F.get(F.array(*[F.lit(c) for c in "CDEFGAB"]), (F.col("l_partkey") % 7).cast("int"))
    acc = F.get(F.array(F.lit(""), F.lit("#"), F.lit("b")), (F.col("l_suppkey") % 3).cast("int"))
    rows = _numbered(spark, sf_dir)
    return rows.select(F.col("l_orderkey").alias("phrase_id"), "seq", step.alias("step"), acc.alias("acc"), F.col("l_linenumber").cast("long").alias("octave"), (F.col("l_suppkey") % 5 == 0).alias("twice"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phrase_id, text): the tokens of each phrase in order, set apart by blanks."""
    rows = tokens(spark, sf_dir).select("phrase_id", F.struct("seq", F.concat("step", "acc", F.col("octave").cast("string")).alias("t")).alias("x"))
    lists = rows.groupBy("phrase_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lists.select("phrase_id", F.array_join(F.transform("xs", lambda x: x["t"]), " ").alias("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phrase_id, truth, read): arrays of MIDI numbers; the read lacks some notes and has others a semitone off."""
    rows = _numbered(spark, sf_dir)
    true = (14 + F.col("l_partkey") % 100).cast("int")
    read = (14 + (F.col("l_partkey") + F.when(F.col("l_quantity") >= 45, 1).otherwise(0)) % 100).cast("int")
    lists = rows.groupBy(F.col("l_orderkey").alias("phrase_id")).agg(
        F.array_sort(F.collect_list(F.struct("seq", true.alias("m")))).alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("l_quantity") >= 8, F.struct("seq", read.alias("m"))))).alias("r"),
    )
    return lists.select("phrase_id", F.transform("t", lambda x: x["m"]).alias("truth"), F.transform("r", lambda x: x["m"]).alias("read"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, part, measure, divisions?, beats?, beat_type?, duration): a read a customer, a measure an order."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    length = F.sum(F.when(F.col("l_returnflag") == "R", 0).otherwise(1 + F.col("l_linenumber") % 3)).cast("int")
    lengths = lines.groupBy("l_orderkey").agg(length.alias("duration"))
    o = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lengths, o == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_custkey").alias("read_id"), F.lit(0).alias("part"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("measure"),
        F.when(o % 4 == 0, (1 + o % 3).cast("int")).alias("divisions"), F.when(o % 3 == 0, (o % 5).cast("int")).alias("beats"),
        F.when(o % 3 == 0, 4).alias("beat_type"), F.coalesce("duration", F.lit(0)).alias("duration"),
    )


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, ctx, grade) in thousandths, as whole numbers."""
    rows = _table(spark, sf_dir, "lineitem").where("l_linenumber % 4 <> 0")
    return rows.select(F.col("l_orderkey").alias("read_id"), (F.round(F.col("l_discount") * 100).cast("long") * 8 + 15).alias("ctx"), (F.round(F.col("l_tax") * 100).cast("long") * 10 + 20).alias("grade"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, mean_ctx, bad_frac, should_accept) of labelled documents."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "n_chars"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("read_id"), ((F.col("n_chars") % 1000) / 1000.0).alias("mean_ctx"), ((F.col("doc_id") % 5) / 4.0).alias("bad_frac"), (F.col("quality") == 1).alias("should_accept"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, pos from 1, v): an image a vector, a grey level a component."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e"))
    return rows.select("image_id", (F.col("pos") + 1).cast("long").alias("pos"), F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int").alias("v"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(staff, x, step, fill, core, wide, tall, stem): marks of a staff from an order's lines; staff and x, step repeat."""
    rows = _table(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey")
    return rows.select(
        F.col("l_orderkey").alias("staff"), F.floor(F.col("l_extendedprice") / 5000).alias("x"), (q % 19 - 5).alias("step"),
        ((p % 100) / 100.0).alias("fill"), ((p % 37 + 63) / 100.0).alias("core"), ((p % 31) / 10.0).alias("wide"), ((p % 23) / 10.0).alias("tall"), (p % 2 == 0).alias("stem"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, v): distinct whole values of a user's events."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.floor("value").cast("long").alias("v")).distinct()
