"""JSON lines as records, read strictly: number kinds are kept, repeated keys refused."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions import metadata as M

PARSED = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("metadata_json", T.StringType()), T.StructField("problem", T.StringType())])


def parse_line(line: str) -> tuple[str, list[float], str | None]:
    """{"id", "vector", "metadata"?}; a numeric id becomes its text, null metadata is absent."""
    value = M.parse(line)
    if not isinstance(value, dict) or not {"id", "vector"} <= set(value) <= {"id", "vector", "metadata"}:
        raise InvalidArgument("a line is an object of id, vector and metadata")
    id, vector, meta = value["id"], value["vector"], value.get("metadata")
    if isinstance(id, (int, float)) and not isinstance(id, bool):
        id = json.dumps(id)
    if not isinstance(id, str):
        raise InvalidArgument("id is a string or number")
    if not isinstance(vector, list) or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in vector):
        raise InvalidArgument("vector is an array of numbers")
    return id, [float(x) for x in vector], None if meta is None else M.canonical(meta)


@F.pandas_udf(PARSED)
def _parsed(lines: pd.Series) -> pd.DataFrame:
    rows = []
    for line in lines:
        try:
            rows.append((*parse_line(line), None))
        except InvalidArgument as e:
            rows.append((None, None, None, str(e)))
    return pd.DataFrame(rows, columns=["id", "vector", "metadata_json", "problem"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, metadata_json, problem) of the non-blank lines; a line that is no record has a problem instead."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(_parsed("value").alias("r")).select("r.*")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file; raises on the first bad line and so writes nothing."""
    rows = read_lines(spark, path)
    bad = rows.where("problem is not null").select("problem").first()
    if bad is not None:
        for number, row in enumerate(spark.read.text(path, wholetext=False).toLocalIterator(), 1):
            if row["value"].strip():
                try:
                    parse_line(row["value"])
                except InvalidArgument as e:
                    raise InvalidArgument(f"line {number}: {e}") from None
        raise InvalidArgument(bad["problem"])
    return rows.select("id", F.col("vector").cast("array<float>").alias("vector"), "metadata_json")
