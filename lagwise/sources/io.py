"""Reading and writing panels.

CSV is read as text first (records may hold quoted line breaks, and know their
position in the file), the reader's missing-value tokens become NULL, and
column types are decided in one aggregate pass (the way a data-frame library
infers them: integers without gaps, numbers, booleans, text).  A text column
becomes a timestamp only when one date format fits all its non-NULL values
(A2).  Parquet is read as is.  Floating NaN is turned into NULL at the scan so
aggregates, ``corr`` and ``dropna`` treat both alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from ..session import freed_shuffles
from .csv_records import POSITION, read_records

# The missing-value tokens a pandas CSV reader treats as NA by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
BOOL_TOKENS = ["True", "False", "true", "false", "TRUE", "FALSE"]

# Date formats that a text column may have, in order of preference: year first, month first, day first, names of months.
_CLOCK = "[ H:mm[:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]]]"
DATE_FORMATS = [f"{day}{clock}" for day in ("y/M/d", "y.M.d", "M/d/y", "M-d-y", "d/M/y", "d-M-y", "d.M.y", "d MMM y", "d-MMM-y", "MMM d, y")
                for clock in (_CLOCK, " h:mm[:ss] a")]


def _q(name: str) -> Column:
    """A column by its exact name (dots and blanks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every float/double column (Spark keeps NaN apart from NULL)."""
    return df.select(*[F.when(~F.isnan(_q(f.name)), _q(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else _q(f.name)
                       for f in df.schema.fields])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns, schema order."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def _timestamp(x: Column, fmt: str | None) -> Column:
    """The timestamp of a text under a format (``None``: ISO, with a full date), else NULL."""
    x = F.trim(x)
    if fmt is None:
        return F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(x))
    # four digits of the year: with one letter the format would take any number of them
    return F.when(x.rlike(r"(^|[^0-9])\d{4}([^0-9]|$)"), F.try_to_timestamp(x, F.lit(fmt)))


def coerce_datetimes(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A2: a string column becomes a timestamp when one format (ISO, else the first of ``DATE_FORMATS``) fits all its
    non-NULL values; a column that needs two formats, or holds anything else, stays text, and so does one of NULLs alone.
    Columns in ``keep`` are left as they are.

    One aggregate: every value has a bit mask of the formats it parses under, and the masks of a column are and-ed.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not strings:
        return df
    formats = [None, *DATE_FORMATS]

    def mask(x: Column) -> Column:
        bits = F.lit(0).cast("long")
        for i, fmt in enumerate(formats):
            bits = bits.bitwiseOR(F.when(_timestamp(x, fmt).isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        # texts of no date-like shape need no parsing
        return F.when(x.isNotNull(), F.when(F.trim(x).rlike(r"^\w{1,4}[-/. ]\w{1,3}[-/., ]+\w{1,4}"), bits).otherwise(F.lit(0).cast("long")))

    one = df.agg(*[F.bit_and(mask(_q(c))).alias(f"m{i}") for i, c in enumerate(strings)]).collect()[0]
    chosen = {c: formats[(m & -m).bit_length() - 1] for c, m in zip(strings, one) if m}
    return df.select(*[_timestamp(_q(c), chosen[c]).alias(c) if c in chosen else _q(c) for c in df.columns])


def _infer_csv_types(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not cols:
        return df
    whole = {c: F.trim(_q(c)).try_cast("bigint") for c in cols}
    number = {c: _q(c).try_cast("double") for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        x = _q(c)
        integral = x.rlike(r"^\s*[+-]?[0-9]+\s*$") & whole[c].isNotNull()
        aggs += [F.count_if(x.isNotNull() & ~integral).alias(f"l{i}"),
                 F.count_if(x.isNotNull() & number[c].isNull()).alias(f"d{i}"),
                 F.count_if(x.isNotNull() & ~x.isin(BOOL_TOKENS)).alias(f"b{i}"),
                 F.count_if(x.isNull()).alias(f"n{i}")]
    s = df.agg(*aggs).collect()[0].asDict()
    typed = {}
    for i, c in enumerate(cols):
        if s[f"n{i}"] == 0 and s[f"l{i}"] == 0:
            typed[c] = whole[c]
        elif s[f"d{i}"] == 0:
            typed[c] = number[c]
        elif s[f"n{i}"] == 0 and s[f"b{i}"] == 0:
            typed[c] = F.lower(_q(c)).eqNullSafe("true")
    return df.select(*[typed[c].alias(c) if c in typed else _q(c) for c in df.columns])


def read_panel(spark: SparkSession, path: str, fmt: str = "csv", null_values: Sequence[str] = NA_TOKENS,
               coerce_dates: bool = True, sep: str = ",", quote: str = '"', row_index: str | None = None) -> DataFrame:
    """A1: read a panel (CSV with header, or Parquet); NaN -> NULL; optional A2.

    ``row_index`` (CSV only) adds a dense 0-based index of that name in the order of the records in the file, files in
    the order of their paths.  See ``read_records`` for the CSV dialect.
    """
    if fmt != "csv":
        if row_index:
            raise ValueError("only CSV rows have a position; index other formats with with_row_index")
        return nan_to_null(spark.read.parquet(path) if fmt == "parquet" else spark.read.format(fmt).load(path))
    tokens = list(null_values)
    raw = read_records(spark, path, sep, quote)
    raw = raw.select(*[F.when(~_q(f.name).isin(tokens), _q(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) and f.name not in POSITION else _q(f.name)
                       for f in raw.schema.fields])
    typed = nan_to_null(_infer_csv_types(raw, keep=POSITION))
    if coerce_dates:
        typed = coerce_datetimes(typed, keep=POSITION)
    if row_index:
        if row_index in typed.columns:
            raise ValueError(f"the file has a column {row_index!r} already")
        typed = typed.select(F.col("_row").alias(row_index), *[_q(c) for c in typed.columns if c != "_row"])
    return typed.drop(*POSITION)


def write_panel(df: DataFrame, path: str, fmt: str = "csv", partition_by: str | Sequence[str] | None = None,
                mode: str = "overwrite", order_by: str | Sequence[str] | None = None, leave_out: Sequence[str] = ()) -> None:
    """Write a result table (CSV with header by default), optionally partitioned.

    ``order_by``: files and the rows in them follow these columns (a range sort; part files in the order of their names),
    so that reading them back by position gives this order again; ``leave_out``: columns (an index that only orders the
    rows, say) that are not written.  CSV quotes are doubled, line breaks are quoted.
    """
    if order_by:
        df = df.orderBy(*[_q(c) for c in ([order_by] if isinstance(order_by, str) else order_by)])
    w = df.drop(*leave_out).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    with freed_shuffles(df.sparkSession):
        _save(w, path, fmt)


def _save(w: DataFrameWriter, path: str, fmt: str) -> None:
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.format(fmt).save(path)


def preview(df: DataFrame, n: int = 5, order_by: str = "row_idx") -> DataFrame:
    """The first rows in index order."""
    return df.orderBy(order_by).limit(n) if order_by in df.columns else df.limit(n)
