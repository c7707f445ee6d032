"""Column expressions over names: sheets, headers, KPI labels, stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally import fixed_values as fv


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def header_text(c: Column | str) -> Column:
    """Trimmed lower-case header, empty for null."""
    return F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().lower() for name in df.columns])


def squash(c: Column | str) -> Column:
    """Lower case without underscores and spaces."""
    return F.translate(F.lower(F.trim(_col(c))), "_ ", "")


def letters_and_digits(c: Column | str) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def kpi_key(c: Column | str) -> Column:
    """KPI label as a lookup key: no dots, one pass of double to single space."""
    no_dots = F.replace(F.lower(F.trim(_col(c))), F.lit("."), F.lit(""))
    return F.replace(no_dots, F.lit("  "), F.lit(" "))


def single_spaced(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(_col(c)), r"\s+", " ")


def sheet_title(c: Column | str, length: int = fv.SHEET_NAME_LENGTH) -> Column:
    return F.substring(_col(c), 1, length)


def title_collisions(df: DataFrame, column: str = "sheet") -> DataFrame:
    """Titles that stand for more than one full sheet name once shortened."""
    return (
        df.select(column).distinct()
        .groupBy(sheet_title(column).alias("title"))
        .agg(F.count(F.lit(1)).alias("names"))
        .filter("names > 1")
    )


def file_safe(c: Column | str) -> Column:
    return F.translate(_col(c), " /", "__")


def identifier_or_unknown(c: Column | str) -> Column:
    """Trimmed identifier; a null or empty one is called Unknown."""
    c = _col(c)
    return F.when(c.isNull() | (c == ""), F.lit(fv.UNKNOWN)).otherwise(F.trim(c))


def identifier_or_blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(_col(c), F.lit("")))


def is_digits(c: Column | str) -> Column:
    return _col(c).rlike("^[0-9]+$")


def matches(c: Column | str, pattern: str) -> Column:
    return _col(c).rlike(pattern)


def last_word(c: Column | str) -> Column:
    return F.element_at(F.split(F.trim(_col(c)), r"\s+"), -1)


def lookup(c: Column | str, table: dict[str, str]) -> Column:
    """Value of a short fixed table for a key, null where the key is unknown."""
    c, found = _col(c), None
    for key, value in table.items():
        found = F.when(c == key, value) if found is None else found.when(c == key, value)
    return F.lit(None).cast("string") if found is None else found


def without_sales_suffix(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(fv.SALES_SUFFIX), F.lit(""))


def with_sales_suffix(c: Column | str) -> Column:
    """Append the suffix unless it is there already."""
    c = _col(c)
    return F.when(c.endswith(fv.SALES_SUFFIX), c).otherwise(F.concat(c, F.lit(fv.SALES_SUFFIX)))


def day_type(c: Column | str) -> Column:
    return F.upper(F.trim(_col(c)))


def short_month(c: Column | str) -> Column:
    """Three-letter form of a full month name; other text passes through."""
    c = F.trim(_col(c))
    return F.when(c.isin(fv.MONTH_NAMES), F.substring(c, 1, 3)).otherwise(c)


def first_present(*cols: Column | str, default: str = fv.UNKNOWN) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols], F.lit(default))


def compare_key(sheet: Column | str, identifier: Column | str, metric: Column | str) -> Column:
    """Printed key: ``sheet - identifier`` and the metric unless it is the plain one."""
    metric = _col(metric)
    suffix = F.when(
        metric.isNull() | metric.isin("", "Actual Sales"), F.lit("")
    ).otherwise(F.concat(F.lit(" "), metric))
    return F.concat(_col(sheet), F.lit(" - "), _col(identifier), suffix)
