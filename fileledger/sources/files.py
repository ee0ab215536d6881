"""Readers for report files: all values as text, headers normalised, input order kept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.operators.validate import ValidationError

ORDER = "_order"


def normalize_headers(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lower-case headers reduced to letters and digits.

    Two headers that become equal are rejected: keeping either would be a guess.
    """
    names = [c if c in keep else re.sub("[^a-z0-9]", "", c.lower()) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValidationError("Report columns are not unique.")
    return df.toDF(*names)


def trimmed_headers(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lower-case trimmed headers, as request lists use them."""
    names = [c if c in keep else c.replace("﻿", "").strip().lower() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValidationError("CSV requires unique column names.")
    return df.toDF(*names)


def _with_order(df: DataFrame) -> DataFrame:
    """Input position: file, split start and line number inside the split."""
    return df.withColumn(
        ORDER,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ),
    )


def read_csv_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column as text. A byte-order mark is tolerated."""
    reader = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", "FAILFAST")
    )
    return _with_order(reader.csv(path))


def _json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file cut behind every closing brace, by as many tasks as it has splits.

    ``lead`` is what stands before the object of a piece, ``plain`` whether the piece holds one
    flat object, or none, with no brace inside a text.
    """
    pieces = _with_order(spark.read.option("lineSep", "}").text(path))
    text = F.regexp_replace("value", "^\ufeff", "")
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    bare_braces = F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))
    staged = pieces.select(ORDER, text.alias("text"), bare.alias("bare"), (braces - bare_braces).alias("inside"), bare_braces.alias("braces"))
    before = F.when(F.col("braces") > 0, F.expr("substring_index(text, '{', braces)")).otherwise(F.col("text"))
    lead = F.regexp_replace(before, r"\s", "")
    record = F.concat(F.lit("{"), F.substring_index("text", "{", -1), F.lit("}"))
    # Quotes left over after whole texts are gone: the brace stood inside a text.
    nested = (F.col("braces") > 0) & F.contains(F.substring_index("bare", "{", -1), F.lit("["))
    whole = (F.col("inside") == 0) & ~nested & ~F.contains(F.replace("bare", F.lit('""'), F.lit("")), F.lit('"'))
    return staged.select(
        F.col(f"{ORDER}.file").alias("file"), ORDER, whole.alias("plain"), lead.alias("lead"),
        F.when(F.col("braces") > 0, record).alias("record"),
    )


def _is_array_of_rows(pieces: DataFrame) -> bool:
    """Whether every file is an array of flat objects, alone or as ``data`` of one object."""
    given, lead = F.col("record").isNotNull(), F.col("lead")
    opens = lead.isin("[", '{"data":[')
    closes = ~given & lead.isin("]", "")
    files = pieces.groupBy("file").agg(
        F.bool_and("plain").alias("plain"), F.count_if(given & opens).alias("opens"),
        F.count_if(given & (lead == ",")).alias("goes_on"), F.count_if(given).alias("records"),
        F.count_if(~given & (lead == "]")).alias("ends"), F.bool_and(given | closes).alias("closed"),
    )
    good = F.col("plain") & (F.col("opens") == 1) & (F.col("goes_on") == F.col("records") - 1) & (F.col("ends") == 1) & F.col("closed")
    found = files.agg(F.bool_and(good).alias("good"), F.count(F.lit(1)).alias("files")).first()
    return bool(found["files"] and found["good"])


def _json_row_columns(rows: DataFrame) -> DataFrame:
    """Objects as columns of text, one for each key there is. A malformed object is an error."""
    parsed = rows.select(ORDER, F.from_json("record", "map<string,string>", {"mode": "FAILFAST"}).alias("_row"))
    keys = sorted(r[0] for r in parsed.select(F.explode(F.map_keys("_row")).alias("k")).distinct().collect())
    return parsed.select(*[F.col("_row")[k].alias(k) for k in keys], ORDER)


def read_json_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON array, JSON lines, or one object holding the rows under ``data``.

    An array of flat objects, as reports are, is cut at its objects and read by many tasks. Any
    other document, such as one with nested objects or a brace inside a text, is read as a whole
    by one task, and fails there if it is malformed.
    """
    if multi_line:
        pieces = _json_pieces(spark, path)
        if _is_array_of_rows(pieces):
            return _json_row_columns(pieces.filter(F.col("record").isNotNull()))
    reader = spark.read.option("multiLine", multi_line).option("primitivesAsString", True)
    rows = _with_order(reader.option("mode", "FAILFAST").json(path))
    if "data" not in rows.columns:
        return rows
    exploded = rows.select(ORDER, F.posexplode("data").alias("_at", "_row"))
    return exploded.select(
        "_row.*", F.struct(F.col(ORDER), F.col("_at").alias("at")).alias(ORDER)
    )


def read_report_rows(
    spark: SparkSession, path: str, file_format: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Rows of a CSV or JSON report with normalised headers.

    ``multi_line``: values of a CSV may hold line breaks, or a JSON file is one document rather
    than lines. By default CSV is read by lines, so that it splits, and JSON as a document.
    """
    kind = file_format or ("json" if path.lower().endswith(".json") else "csv")
    if kind == "json":
        rows = read_json_rows(spark, path, True if multi_line is None else multi_line)
    else:
        rows = read_csv_rows(spark, path, bool(multi_line))
    return normalize_headers(rows, keep=(ORDER,))
