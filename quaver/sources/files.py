"""File sources: JSON datasets, gate parameters, zipped MusicXML and grade files, PGM rasters."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "image string, piece string, quality string, gt_tokens array<string>, gt_midi array<int>"
DATASET = (
    "image string, piece string, quality string, gt array<string>, audiveris_ok boolean, notes array<string>, agreement double, "
    "should_accept boolean, features struct<note_count:int,wild_frac:double,measures_bad_frac:double,measures_total:int,"
    "mean_ctx:double,min_ctx:double,head_count:int,weak_frac:double>, note string"
)
PARAMS = "CTX_MEAN_MIN string, MEASURE_BAD_FRACTION string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labelled images."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of scored reads; blank lines are skipped."""
    return spark.read.schema(DATASET).json(path)


def gate_candidates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Candidates for gate.thresholds(), first path first; paths that are not there are left out."""
    jvm, rows = spark._jvm, None
    for i, path in enumerate(paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            one = spark.read.schema(PARAMS).option("multiLine", True).json(path)
            one = one.select(F.lit(i).alias("priority"), F.lit(path).alias("path"), F.col("CTX_MEAN_MIN").alias("ctx_mean_min"), F.col("MEASURE_BAD_FRACTION").alias("measure_bad_fraction"))
            rows = one if rows is None else rows.union(one)
    return spark.createDataFrame([], "priority int, path string, ctx_mean_min string, measure_bad_fraction string") if rows is None else rows


def _zip_members(data: bytes):
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return [(n, archive.read(n).decode("utf-8", errors="ignore")) for n in archive.namelist()]
    except zipfile.BadZipFile:
        return []


def score_in(path: str, data: bytes) -> str | None:
    """MusicXML text of a file: the first XML member outside META-INF of .mxl, or the file itself; null if there is none."""
    if path.lower().endswith(".mxl"):
        found = [t for n, t in _zip_members(data) if n.lower().endswith((".xml", ".musicxml")) and "META-INF" not in n]
        return found[0] if found else None
    return None if "META-INF" in path else data.decode("utf-8", errors="ignore")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """(read_id: the file's folder, musicxml): one score a folder, .mxl before .musicxml before .xml, then by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{mxl,musicxml,xml}").load(folder)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "musicxml": [score_in(p, bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)]})

    rows = files.select("path", "content").mapInPandas(run, "path string, musicxml string").where("musicxml is not null")
    kind = F.when(F.lower("path").endswith(".mxl"), 0).when(F.lower("path").endswith(".musicxml"), 1).otherwise(2)
    rows = rows.withColumn("read_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return rows.groupBy("read_id").agg(F.min_by("musicxml", F.struct(kind, "path")).alias("musicxml"))


_HEAD = re.compile(r"<head(?=[\s/>])[^>]*>")
_ATTRIBUTE = re.compile(r'(?<![\w-])([\w-]+)="([^"]*)"')


def heads_in(data: bytes) -> list[dict]:
    """Noteheads of a grade archive: head elements of its sheet files that have a grade."""
    out = []
    for name, text in _zip_members(data):
        if name.endswith(".xml") and "sheet#" in name:
            for tag in _HEAD.findall(text):
                a = dict(_ATTRIBUTE.findall(tag))
                if re.fullmatch(r"[0-9.]+", a.get("grade", "")):
                    ctx, at = a.get("ctx-grade", ""), a.get("pitch", "")
                    grade = float(a["grade"])
                    shape = a.get("shape", "")
                    out.append({"shape": shape if re.fullmatch("[A-Z_]+", shape) else "", "grade": grade, "ctx": float(ctx) if re.fullmatch(r"[0-9.]+", ctx) else grade, "pitch": int(at) if re.fullmatch(r"-?\d+", at) else None})
    return out


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """(read_id: the file's name, shape, grade, ctx, pitch) of grade archives (*.omr); archives that can't be read have none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.omr").load(folder)

    def run(frames):
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                rows = heads_in(bytes(c))
                if rows:
                    name = re.search(r"([^/]+)\.omr$", p)[1]
                    yield pd.DataFrame(rows).astype({"pitch": "Int32"}).assign(read_id=name)[["read_id", "shape", "grade", "ctx", "pitch"]]

    return files.select("path", "content").mapInPandas(run, "read_id string, shape string, grade double, ctx double, pitch int")


def rasters(spark: SparkSession, folder: str, clef: str = "treble") -> DataFrame:
    """(image_id, path, height, width, data, clef) of binary PGM images; files that are none have null data.

    image_id is a hash of the path. Other formats, page description languages and text recognition need tools that are
    not part of the engine: their results enter as tables of the same schema.
    """
    from quaver.operators.detect import decode_pgm

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pgm").load(folder)

    def run(frames):
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"], strict=True):
                try:
                    gray = decode_pgm(bytes(c))
                    rows.append((p, *gray.shape, gray.tobytes()))
                except ValueError:
                    rows.append((p, 0, 0, None))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "data"])

    found = files.select("path", "content").mapInPandas(run, "path string, height int, width int, data binary")
    return found.select(F.xxhash64("path").alias("image_id"), "path", "height", "width", "data", F.lit(clef).alias("clef"))
