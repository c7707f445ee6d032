"""Cleaning of names and values, over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.checks.base import check
from salestally.functions import names, values
from salestally.model import read_table
from salestally.operators import report

_MESSY = "'  ' || upper(p_name) || '_' || p_brand || '  / ' || p_type || '. '"


def _parts(spark, folder):
    return read_table(spark, folder, "part").withColumn("raw", F.expr(_MESSY))


@check("names_normalised", f"""SELECT p_partkey, lower(trim(raw)) AS header,
  translate(lower(trim(raw)), '_ ', '') AS squashed,
  regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS alnum,
  replace(replace(lower(trim(raw)), '.', ''), '  ', ' ') AS kpi,
  regexp_replace(trim(raw), '\\s+', ' ', 'g') AS spaced,
  substr(raw, 1, 31) AS title, translate(raw, ' /', '__') AS safe
FROM (SELECT p_partkey, {_MESSY} AS raw FROM part)""")
def _(spark, folder):
    return _parts(spark, folder).select(
        "p_partkey", names.header_text("raw").alias("header"), names.squash("raw").alias("squashed"),
        names.letters_and_digits("raw").alias("alnum"), names.kpi_key("raw").alias("kpi"),
        names.single_spaced("raw").alias("spaced"), names.sheet_title("raw").alias("title"),
        names.file_safe("raw").alias("safe"))


_SHEET = "'Sales Summary_' || p_name || ' of ' || p_brand || ' by ' || p_type"


@check("title_collisions", f"""SELECT substr(sheet, 1, 31) AS title, count(DISTINCT sheet) AS names
FROM (SELECT {_SHEET} AS sheet FROM part) GROUP BY 1 HAVING count(DISTINCT sheet) > 1""")
def _(spark, folder):
    return names.title_collisions(
        read_table(spark, folder, "part").select(F.expr(_SHEET).alias("sheet")))


# amounts written in seven ways, by the order's key
_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(28,2)) AS {text})"


def _written(text: str, thousands: str, mod: str) -> str:
    cents = _CENTS.format(text=text)
    return f"""CASE {mod}
  WHEN 0 THEN {cents} WHEN 1 THEN '$' || {thousands} WHEN 2 THEN '₹' || {cents}
  WHEN 3 THEN {cents} || 'K' WHEN 4 THEN ' ' || {cents} || ' '
  WHEN 5 THEN 'N/A' WHEN 6 THEN {cents} || 'e1' ELSE NULL END"""


_SPARK_WRITTEN = _written("STRING", "format_number(CAST(o_totalprice AS DECIMAL(28,2)), 2)", "o_orderkey % 8")
_DUCK_WRITTEN = _written("VARCHAR", "format('{:,.2f}', o_totalprice)", "o_orderkey % 8")


def _amounts(spark, folder):
    return read_table(spark, folder, "orders").select("o_orderkey", F.expr(_SPARK_WRITTEN).alias("raw"))


_V = "CAST(o_totalprice AS DECIMAL(28,2))"


@check("values_rounded", f"""SELECT o_orderkey, CAST(amount AS DOUBLE) AS amount,
  coalesce(CAST(amount AS VARCHAR), raw) AS compared,
  CASE WHEN raw IS NULL THEN 'empty' WHEN amount IS NULL THEN 'text' ELSE 'numeric' END AS kind
FROM (SELECT o_orderkey, {_DUCK_WRITTEN} AS raw,
  CASE WHEN o_orderkey % 8 IN (5, 7) THEN NULL WHEN o_orderkey % 8 = 6 THEN {_V} * 10 ELSE {_V} END AS amount
  FROM orders)""".replace("CAST(amount AS VARCHAR)", "CAST(CAST(amount AS DECIMAL(28,2)) AS VARCHAR)"))
def _(spark, folder):
    return _amounts(spark, folder).select(
        "o_orderkey", values.rounded("raw").alias("amount"),
        values.comparable("raw").alias("compared"), values.value_kind("raw").alias("kind"))


@check("values_scaled", f"""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 8 IN (5, 7) THEN NULL
  WHEN o_orderkey % 8 = 3 THEN {_V} * 1000 WHEN o_orderkey % 8 = 6 THEN {_V} * 10 ELSE {_V} END AS DOUBLE) AS amount
FROM orders""")
def _(spark, folder):
    return _amounts(spark, folder).select(
        "o_orderkey", values.rounded("raw", scale_suffix=True).alias("amount"))


@check("values_normalised", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN '0'
  WHEN o_orderkey % 8 = 5 THEN 'N/A'
  ELSE regexp_replace(regexp_replace(CAST(CAST({_V} *
       CASE o_orderkey % 8 WHEN 3 THEN 1000 WHEN 6 THEN 10 ELSE 1 END AS DECIMAL(28,2)) AS VARCHAR),
       '0+$', ''), '\\.$', '') END AS canonical
FROM orders""")
def _(spark, folder):
    return _amounts(spark, folder).select("o_orderkey", values.normalised("raw").alias("canonical"))


@check("value_kinds", """SELECT CASE WHEN o_orderkey % 8 = 7 THEN 'empty' WHEN o_orderkey % 8 = 5 THEN 'text'
  ELSE 'numeric' END AS kind, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, folder):
    return report.value_kinds(_amounts(spark, folder), "raw")


@check("months_short", """SELECT substr(label, 1, 3) AS month, label AS written, count(*) AS n
FROM (SELECT strftime(o_orderdate, '%B') AS label FROM orders) GROUP BY 1, 2
UNION ALL SELECT o_orderpriority, o_orderpriority, count(*) FROM orders GROUP BY 1, 2""")
def _(spark, folder):
    """Full month names are shortened, other labels stay."""
    orders = read_table(spark, folder, "orders")
    labels = orders.select(F.date_format("o_orderdate", "MMMM").alias("written")).unionAll(
        orders.select("o_orderpriority"))
    return labels.groupBy(names.short_month("written").alias("month"), "written").agg(
        F.count(F.lit(1)).alias("n"))


@check("day_type_labels", """SELECT CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'WEEKEND' ELSE 'WEEKDAY' END AS base,
  CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'WEEKEND SALES' ELSE 'WEEKDAY SALES' END AS label,
  count(*) AS n FROM orders GROUP BY 1, 2""")
def _(spark, folder):
    """The suffix is put on once, whether or not it is there, and taken off again."""
    weekend = F.dayofweek("o_orderdate").isin(1, 7)
    raw = F.concat(F.lit(" "), F.when(weekend, "weekend").otherwise("weekday"),
                   F.when(F.col("o_orderkey") % 2 == 0, F.lit(" sales")).otherwise(F.lit("")))
    label = names.with_sales_suffix(names.day_type(raw))
    return read_table(spark, folder, "orders").groupBy(
        names.without_sales_suffix(label).alias("base"), label.alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))


@check("compare_keys", """SELECT s_suppkey, 'Stores - ' || s_name AS plain, 'Stores - ' || s_name || ' Target' AS target,
  'Stores - ' || s_name || ' Units' AS other FROM supplier""")
def _(spark, folder):
    def key(metric):
        return names.compare_key(F.lit("Stores"), F.col("s_name"), F.lit(metric))
    return read_table(spark, folder, "supplier").select(
        "s_suppkey", key("Actual Sales").alias("plain"), key("Target").alias("target"),
        key("Units").alias("other"))


@check("amounts_displayed", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'Not Found'
  WHEN o_orderkey % 5 = 2 THEN 'N/A' ELSE '$' || format('{:,.2f}', o_totalprice) END AS shown FROM orders""")
def _(spark, folder):
    amount = F.when(F.col("o_orderkey") % 5 != 2, F.col("o_totalprice").cast("decimal(28,2)"))
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        values.display_amount(amount, F.col("o_orderkey") % 5 != 1).alias("shown"))


@check("declared_types", """SELECT event_type, count(*) AS n, sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END)::BIGINT AS users,
  CAST(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(value AS DECIMAL(28,2)) END) AS DOUBLE) AS total,
  sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE length(event_type) END)::BIGINT AS letters
FROM events GROUP BY 1""")
def _(spark, folder):
    """Text that is no number becomes null, nulls become the default of the SQL type."""
    n = F.col("event_id")
    raw = read_table(spark, folder, "events").select(
        "event_type",
        F.when(n % 3 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("users"),
        F.when(n % 4 == 0, F.lit("-")).otherwise(F.col("value").cast("decimal(28,2)").cast("string")).alias("total"),
        F.when(n % 5 != 0, F.col("event_type")).alias("label"))
    types = {"users": "bigint", "total": "decimal", "label": "nvarchar"}
    filled = values.fill_nulls(values.cast_declared(raw, types), types)
    return filled.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("users").alias("users"),
        F.sum("total").alias("total"), F.sum(F.length("label")).alias("letters"))


@check("rows_as_maps", "SELECT p_partkey, p_name || '|' || p_size AS text, CAST(6 AS BIGINT) AS n FROM part")
def _(spark, folder):
    parts = read_table(spark, folder, "part")
    row = values.row_map(parts)
    return parts.select(
        "p_partkey", F.concat_ws("|", row["p_name"], row["p_size"]).alias("text"),
        F.size(row).cast("bigint").alias("n"))


@check("digits_and_patterns", """SELECT c_custkey, regexp_matches(substr(c_name, 10), '^[0-9]+$') AS digits,
  regexp_matches(lower(c_name || ' ' || c_mktsegment), 'auto.*|.*house') AS fits, 'HOUSEHOLD' AS first
FROM customer""".replace("'HOUSEHOLD' AS first", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name ELSE 'Unknown' END AS first"))
def _(spark, folder):
    k = F.col("c_custkey") % 3
    week = F.when(k == 0, F.col("c_mktsegment")).when(k == 1, F.lit(""))
    category = F.when(k == 1, F.col("c_name")).otherwise(F.lit(None).cast("string"))
    text = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return read_table(spark, folder, "customer").select(
        "c_custkey", names.is_digits(F.substring("c_name", 10, 100)).alias("digits"),
        names.matches(text, "auto.*|.*house").alias("fits"),
        names.first_present(week, category).alias("first"))


@check("null_rules", """SELECT CASE k WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Unknown' WHEN 2 THEN '' ELSE c_name END AS identifier,
  CASE WHEN k IN (0, 1, 2) THEN '' ELSE c_name END AS blank, CASE WHEN k = 3 THEN '0' ELSE CAST(c_custkey AS VARCHAR) END AS value,
  count(*) AS n FROM (SELECT *, c_custkey % 6 AS k FROM customer) GROUP BY 1, 2, 3""")
def _(spark, folder):
    """Null or empty identifiers are Unknown, blanks stay blank, null values read as 0."""
    k = F.col("c_custkey") % 6
    raw = F.when(k == 1, F.lit("")).when(k == 2, F.lit("  ")).when(k > 2, F.concat(F.lit(" "), "c_name"))
    value = F.when(k != 3, F.col("c_custkey").cast("string"))
    return read_table(spark, folder, "customer").groupBy(
        names.identifier_or_unknown(raw).alias("identifier"),
        names.identifier_or_blank(raw).alias("blank"),
        F.coalesce(value, F.lit("0")).alias("value"),
    ).agg(F.count(F.lit(1)).alias("n"))


@check("times_as_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def _(spark, folder):
    return read_table(spark, folder, "events").select("event_id", values.stamp("ts").alias("stamp"))


@check("code_lookup", """SELECT p_brand AS brand, CASE p_brand WHEN 'Brand#1' THEN 'CRC' WHEN 'Brand#2' THEN 'AMS' END AS code,
  count(*) AS n FROM part GROUP BY 1, 2""")
def _(spark, folder):
    """Brands by code table, null where the table has no entry."""
    codes = {"Brand#1": fv.BRAND_CODES["CRC Press"],
             "Brand#2": fv.BRAND_CODES["American Mathematical Society"]}
    return read_table(spark, folder, "part").groupBy(
        F.col("p_brand").alias("brand"), names.lookup("p_brand", codes).alias("code")
    ).agg(F.count(F.lit(1)).alias("n"))
