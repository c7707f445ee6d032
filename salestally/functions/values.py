"""Column expressions over values: cleaning, rounding, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.functions.names import _col

WIDE = "decimal(38,12)"


def _number(text: Column, scale: Column | None = None) -> Column:
    """Number in plain text, null if the text is none.

    The pattern guards the cast: Spark would also read forms such as "1.0d".
    A number beyond the type's range is none, scaled or not.
    """
    parsed = F.when(text.rlike(fv.NUMBER_PATTERN), text.try_cast(WIDE))
    if scale is not None:
        parsed = F.try_multiply(parsed, scale)
    return parsed


def without_thousands(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(","), F.lit(""))


def rounded(c: Column | str, scale_suffix: bool = False) -> Column:
    """Amount in a report cell, rounded to cents; null where it is no number.

    Currency signs, separators and the letters K and M are dropped. With
    ``scale_suffix`` a final K or M multiplies instead.
    """
    c = _col(c)
    text = F.trim(F.translate(c, fv.COMPARE_STRIP, ""))
    scale = None
    if scale_suffix:
        last = F.right(F.trim(c), F.lit(1))
        scale = (
            F.when(last == "K", F.lit(fv.SUFFIX_SCALE["K"]))
            .when(last == "M", F.lit(fv.SUFFIX_SCALE["M"]))
            .otherwise(F.lit(1))
        )
    return F.round(_number(text, scale), fv.DECIMAL_PLACES).cast("decimal(38,2)")


def comparable(c: Column | str, scale_suffix: bool = False) -> Column:
    """Text two cells are compared by: the rounded amount, else the raw text."""
    return F.coalesce(rounded(c, scale_suffix).cast("string"), _col(c))


def normalised(c: Column | str) -> Column:
    """One canonical text per value: blanks are 0, suffixes scale, no trailing zeros."""
    text = F.trim(_col(c))
    bare = F.translate(text, fv.NORMALISE_STRIP, "")
    suffix = F.regexp_extract(bare, "([KMB])$", 1)
    scale = F.lit(1)
    for letter, factor in fv.SUFFIX_SCALE.items():
        scale = F.when(suffix == letter, F.lit(factor)).otherwise(scale)
    number = F.round(
        _number(F.trim(F.regexp_replace(bare, "[KMB]$", "")), scale), fv.DECIMAL_PLACES
    ).cast("decimal(38,2)")
    plain = F.regexp_replace(number.cast("string"), r"(\.0+$)|(?<=\.[0-9])0$", "")
    return F.when(
        text.isNull() | F.lower(text).isin(fv.NULL_WORDS), F.lit("0")
    ).otherwise(F.coalesce(plain, text))


def value_kind(c: Column | str) -> Column:
    """numeric, text or empty."""
    c = _col(c)
    return (
        F.when(c.isNull() | (F.trim(c) == ""), F.lit("empty"))
        .when(rounded(c).isNotNull(), F.lit("numeric"))
        .otherwise(F.lit("text"))
    )


def display_amount(c: Column | str, found: Column | None = None) -> Column:
    """Currency sign, thousands separators and two places; N/A for null."""
    text = F.coalesce(
        F.concat(F.lit(fv.CURRENCY_SYMBOL), F.format_number(_col(c), fv.DECIMAL_PLACES)),
        F.lit(fv.NULL_DISPLAY),
    )
    if found is not None:
        text = F.when(found, text).otherwise(F.lit(fv.NOT_FOUND))
    return text


def stamp(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss")


def percent(part: Column, whole: Column) -> Column:
    """Share with one decimal and a percent sign, 0% of nothing."""
    share = F.format_string("%.1f%%", F.try_divide(part * F.lit(100.0), whole))
    return F.when(whole > 0, share).otherwise(F.lit("0%"))


def fill_nulls(df: DataFrame, sql_types: dict[str, str]) -> DataFrame:
    """Replace nulls by the default of each column's declared SQL type."""
    defaults = {}
    for name, sql_type in sql_types.items():
        default = fv.SQL_TYPES[sql_type][1]
        if default is not None:
            defaults[name] = default
    return df.na.fill(defaults)


def cast_declared(df: DataFrame, sql_types: dict[str, str]) -> DataFrame:
    """Cast columns to the Spark types of their declared SQL types."""
    return df.withColumns(
        {name: F.col(name).try_cast(fv.SQL_TYPES[t][0]) for name, t in sql_types.items()}
    )


def row_map(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Row as a map from column name to text."""
    names = columns or df.columns
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]),
        F.array(*[F.col(f"`{n}`").cast("string") for n in names]),
    )
