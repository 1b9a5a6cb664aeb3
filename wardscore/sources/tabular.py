"""Reading and writing of tables.

CSV columns are read as text and typed later by the jobs, so that one bad value
never fails a scan or changes a column's type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardscore.functions.clean import id_text, to_number
from wardscore.functions.codes import borough_of
from wardscore.operators.tables import col, keep_known, require_columns


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    required: Sequence[str] = (),
    skip_bad_rows: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header, all text, pruned to the known ``columns`` present.

    The header is probed first, so missing required columns raise before a job
    over the data; a file whose header differs from the first one's raises, as
    its columns would be taken by position. Rows with too few fields are filled
    with NULL; those with too many lose the surplus, or are dropped on demand.
    Lines end rows; with ``multi_line`` quoted fields may hold line ends, and a
    file is then read by one task.
    """
    # Quoted fields may hold quotes doubled, as CSV writers do.
    reader = spark.read.options(header=True, escape='"', enforceSchema=False, multiLine=multi_line)
    header = reader.csv(path).columns
    schema = text_schema(header)
    if skip_bad_rows:
        # A row with another number of fields than the header is kept as it was written, too.
        # A row parsed for a few columns only is not seen to be too long.
        raw = "_row_as_written"
        marked = reader.options(columnNameOfCorruptRecord=raw, columnPruning=False).schema(text_schema([*header, raw]))
        unquoted = F.regexp_replace(col(raw), '"(?:[^"]|"")*"', "")
        too_long = F.regexp_count(unquoted, F.lit(",")) >= len(header)
        df = marked.csv(path)
        # Spark wants another column read with this one, so that a count sees the rows parsed.
        parsed = F.length(F.coalesce(col(header[0]), F.lit(""))) >= 0
        df = df.where(parsed & (col(raw).isNull() | ~too_long)).select(*[col(c) for c in header])
    else:
        df = reader.schema(schema).csv(path)
    df = require_columns(df, required)
    return df if columns is None else keep_known(df, [*required, *[c for c in columns if c not in required]])


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet, pruned to the known ``columns`` present."""
    df = spark.read.parquet(path)
    return df if columns is None else keep_known(df, columns)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A written index: canonical text ids, numbers typed, borough added."""
    df = read_csv(spark, path)
    texts = ("Community_District_ID", "Community_District_Name")
    typed = df.select(*[col(c) if c in texts else to_number(col(c)).alias(c) for c in df.columns])
    return typed.withColumn("Community_District_ID", id_text(F.col("Community_District_ID"))).withColumn(
        "borough", borough_of(F.col("Community_District_ID"))
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False) -> None:
    """Overwrite a table; ``single_file`` is for tables known to be tiny."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        # By default the writer would strip blanks around texts.
        keep_blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(header=True, escape='"', **keep_blanks).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.format(fmt).save(path)


def land_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table unless it is there already."""
    writer = df.write.mode("ignore")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
