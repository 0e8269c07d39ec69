"""Uploads and what reads them: which files are taken, and a reader that is a program of its own."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.functions import pitch as P
from quaver.sources import files

# The largest upload, the suffixes taken, what is told of others, and how long a reader may take.
MOST_BYTES = 20 * 1024 * 1024
SUFFIXES = (".bmp", ".gif", ".jpeg", ".jpg", ".pdf", ".png", ".tif", ".tiff", ".webp")
TOO_LARGE, UNSUPPORTED, NO_FILE = "Upload too large (max {} MB)", "Unsupported file type {}; expected one of {}", "No file field found"
TIMEOUT = 300


def checked(uploads: DataFrame, suffixes=SUFFIXES, most: int = MOST_BYTES) -> DataFrame:
    """uploads (name, content) with suffix and error: why a file is not taken, null if it is.

    A file is judged by its size first, then by whether there is any, then by its suffix in lower case.
    """
    suffix = P.suffix(F.coalesce("name", F.lit("")))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    told = F.concat(*[F.when(suffix == "", "(none)").otherwise(suffix) if part is None else F.lit(part) for part in (UNSUPPORTED.split("{}")[0], None, UNSUPPORTED.split("{}")[1] + ", ".join(sorted(suffixes)))])
    error = F.when(size > most, TOO_LARGE.format(most // (1024 * 1024))).when(size == 0, NO_FILE).when(~suffix.isin(*suffixes), told)
    return uploads.withColumn("suffix", suffix).withColumn("error", error)


def available(command: list[str]) -> bool:
    """Whether the program of a reader is there, on this machine."""
    return shutil.which(command[0]) is not None


def read_by(uploads: DataFrame, command: list[str], timeout: float = TIMEOUT) -> DataFrame:
    """(image, musicxml, heads array, note) of uploads (image, name, content), read by a program: one file at a time.

    The program is called with the file and a folder for what it makes; it must be on every executor. A read is good if
    there is a score in that folder when it ends, whatever it returns; musicxml is null otherwise, and note says why. Its
    grades are those of the first archive (*.omr) that is left there. Folders are of one call and go with it.
    """

    def one(name: str, content: bytes) -> tuple:
        with tempfile.TemporaryDirectory() as folder:
            source, out = Path(folder, "source" + Path(name or "").suffix.lower()), Path(folder, "out")
            source.write_bytes(content)
            out.mkdir()
            told = ""
            try:
                done = subprocess.run([*command, str(source), str(out)], capture_output=True, timeout=timeout, check=False)
                told = done.stderr.decode("utf-8", errors="ignore").strip()
            except subprocess.TimeoutExpired:
                told = f"The reader took more than {timeout:g} s"
            except OSError as e:
                return None, [], f"The reader can't be run: {e}"
            kinds = {".mxl": 0, ".musicxml": 1, ".xml": 2}
            made = sorted((kinds[p.suffix.lower()], str(p)) for p in out.rglob("*") if p.suffix.lower() in kinds)
            scores = (files.score_in(p, Path(p).read_bytes()) for _, p in made)
            score = next((s for s in scores if s is not None), None)
            grades = sorted(out.rglob("*.omr"))
            heads = files.heads_in(grades[0].read_bytes()) if grades else []
            return score, heads, None if score is not None else told or "The reader made no score"

    def run(frames):
        for f in frames:
            rows = [one(n, bytes(c) if c is not None else b"") for n, c in zip(f["name"], f["content"], strict=True)]
            yield pd.DataFrame({"image": f["image"], "musicxml": [r[0] for r in rows], "heads": [r[1] for r in rows], "note": [r[2] for r in rows]})

    kind = "image string, musicxml string, heads array<struct<shape:string,grade:double,ctx:double,pitch:int>>, note string"
    return uploads.select(F.col("image").cast("string").alias("image"), "name", "content").mapInPandas(run, kind)
