"""Raw-intake readers (S1-S3, S5, S6) and header discovery/promotion.

Raw files are read with an all-string schema; CSV NA tokens become NULL at
ingest. A headerless sheet is ``(row_pos, c0..cN)`` string cells: the header
row is found by content with one filtered ``min(row_pos)`` (a single number
reaches the driver), then promoted by a projection built from that one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import specs
from riskloom.functions import parse
from riskloom.session import stored


def na_tokens_to_null(df: DataFrame, keep: tuple[str, ...] = ("row_pos",)) -> DataFrame:
    """Whole-field CSV NA tokens become NULL in every string column."""
    return df.select(
        *[
            parse.csv_na_to_null(c).alias(c) if c not in keep and isinstance(df.schema[c].dataType, T.StringType) else F.col(c)
            for c in df.columns
        ]
    )


def in_file_order(df: DataFrame) -> DataFrame:
    """``df`` (just read from files) with ``row_pos``: 0, 1, ... by file path, then place in the file.

    Every row is landed once with its file, the start of its block and its place within
    the block; a count per block gives each block's offset. Rows are not sorted or
    shuffled; the offsets table has one row per block of the input.
    """
    tagged = df.withColumns(
        {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_place": F.monotonically_increasing_id()}
    )
    landed = stored(tagged, "landed")
    # a task reads a block in order, so that places within a block rise by one
    blocks = landed.groupBy("_file", "_block").agg(F.min("_place").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = landed.join(F.broadcast(offsets), ["_file", "_block"])
    return numbered.withColumn("row_pos", F.col("_before") + F.col("_place") - F.col("_from")).select("row_pos", *df.columns)


def read_raw_csv(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Headered CSV, every field a string, NA tokens -> NULL, plus ``row_pos`` in file order.

    ``columns`` are picked by the header's names, whatever their order in the file.
    """
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if columns:
        require_columns(df, columns, str(path))
        df = df.select(*columns)
    return na_tokens_to_null(in_file_order(df))


def read_headerless(spark: SparkSession, path, n_cells: int) -> DataFrame:
    """Headerless CSV sheet as (row_pos, c0..c{n-1}) string cells, in file order over all files."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n_cells)])
    return in_file_order(spark.read.option("header", False).schema(schema).csv(path))


def read_clean_rows(spark: SparkSession, path: str) -> DataFrame:
    """S3: headered CSV with every field kept as a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def require_columns(df: DataFrame, required, what: str) -> None:
    """P5: raise listing every missing required column (plan-build time, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"{what}: no column {', '.join(missing)}")


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


HEADER_ROWS = 1000


def find_header(cells: DataFrame, markers=specs.DATA2_HEADER_MARKERS) -> tuple[int, list[tuple[str, str]]]:
    """P1 + P2: the first row whose trimmed lower-cased cells contain every marker.

    A filter and a top-1 by row_pos (only that one row reaches the driver), on rows before HEADER_ROWS first.
    Returns (header row_pos, [(cell column, trimmed header name)] for non-blank headers).
    """
    cell_cols = [c for c in cells.columns if c != "row_pos"]
    # every marker must equal some trimmed, lower-cased cell (plain ORs: stays in codegen)
    cond = F.lit(True)
    for m in markers:
        any_cell = F.lit(False)
        for c in cell_cols:
            any_cell = any_cell | F.coalesce(F.lower(parse.strip(F.col(c))) == F.lit(m), F.lit(False))
        cond = cond & any_cell
    # a header among the first rows is the first of all; only without one the other rows are searched
    early = F.coalesce(F.col("row_pos") < HEADER_ROWS, F.lit(True))
    hit = cells.filter(early).filter(cond).orderBy("row_pos").limit(1).collect()
    hit = hit or cells.filter(~early).filter(cond).orderBy("row_pos").limit(1).collect()
    if not hit:
        raise ValueError(f"no header row: none holds all of {list(markers)}")
    header = hit[0]
    named = [(c, str(header[c]).strip()) for c in cell_cols if header[c] is not None and str(header[c]).strip()]
    names = [n for _, n in named]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate header names: {names}")
    return int(header["row_pos"]), named


def promote_header(cells: DataFrame, header_pos: int, named: list[tuple[str, str]]) -> DataFrame:
    """P2 + P3: rows after the header, named by it; blank-header columns dropped; all-NULL rows dropped."""
    body = cells.filter(F.col("row_pos") > header_pos).select("row_pos", *[F.col(c).alias(n) for c, n in named])
    return body.dropna(how="all", subset=[n for _, n in named])


def read_records_json(spark: SparkSession, path: str, schema: T.StructType, layout: str = "document") -> DataFrame:
    """Request records with a fixed schema; anything unparsable lands in ``_corrupt_record``.

    layout="document": each file is one JSON object or one JSON array of objects;
    layout="lines": JSON lines (one object per line, splittable).
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return (
        spark.read.schema(full)
        .option("multiLine", layout == "document")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def read_records_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV records; columns are matched to ``schema`` by header name (absent
    ones are NULL), every field read as text first, NA tokens become NULL, then typed."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = na_tokens_to_null(raw, keep=())
    cols = [
        (F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return raw.select(*cols)
