"""What is written: JSON lines, gate parameters, and answers as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nulls are written, so that every row has all its fields.
_WHOLE = {"ignoreNullFields": "false"}


def write_rows(rows: DataFrame, path: str) -> None:
    """Datasets (as sources.files.dataset()) and manifests: a JSON object a line."""
    rows.write.json(path, ignoreNullFields=False)


def write_params(row: DataFrame, path: str) -> None:
    """The one row of calibrate.calibrated() under the names that gate_candidates() reads."""
    names = {"ctx_mean_min": "CTX_MEAN_MIN", "measure_bad_fraction": "MEASURE_BAD_FRACTION"}
    row.withColumnsRenamed(names).write.json(path, ignoreNullFields=False)


def answer(*columns: str | Column) -> Column:
    """JSON text of the columns, as a service answers with it."""
    return F.to_json(F.struct(*columns), _WHOLE)
