"""Drill-through: targets, parameters, queries and what a filter can do.

Each function takes a table of requests and adds columns. Fixed tables of a
known, small size are map expressions; tables that come as data are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.functions.names import is_digits, last_word, lookup
from salestally.params import PARAM_SCHEMA, Params


def drill_target(title: Column | str, table: dict[str, str] | None = None) -> Column:
    """Target of a widget; without an entry the last word of its title."""
    return F.coalesce(lookup(title, table or fv.DRILL_TARGETS), last_word(title))


def query_name(title: Column, target: Column, rules=None) -> Column:
    """Query for a widget and a target, the widget's default, or a name made of the title."""
    rules = fv.DRILL_QUERIES if rules is None else rules
    exact = {f"{t}\x1f{s}": q for t, s, q in rules if s is not None}
    default = {t: q for t, s, q in rules if s is None}
    return F.coalesce(
        lookup(F.concat(title, F.lit("\x1f"), target), exact),
        lookup(title, default),
        F.concat(F.lit("DR_"), F.replace(title, F.lit(" "), F.lit(""))),
    )


def filter_kind(target: Column | str, table: dict[str, str] | None = None) -> Column:
    return F.coalesce(lookup(target, table or fv.FILTER_KINDS), F.lit("none"))


def scope_warning(target: Column | str, table: dict[str, str] | None = None) -> Column:
    """Whether the target's filter does not reach the query."""
    return filter_kind(target, table) == "none"


def with_store_id(df: DataFrame, name: str, stores: DataFrame) -> DataFrame:
    """Add ``store_id``: by name from a table (name, id), digits as they are, else null."""
    table = stores.select(F.col("name").alias(name), F.col("id").alias("_id"))
    digits = F.when(is_digits(name), F.col(name))
    return (
        df.join(table, name, "left").withColumn("store_id", F.coalesce("_id", digits)).drop("_id")
    )


def with_params(df: DataFrame, target: str, presets: DataFrame, stores: DataFrame,
                defaults: Params) -> DataFrame:
    """Add the seven parameters of a target.

    A preset of the target wins whole; otherwise a store's id is put into the
    defaults; otherwise the defaults hold. presets: target and the parameters.
    """
    fields = fv.PARAM_FIELDS
    preset = presets.select(
        F.col("target").alias(target), F.lit(True).alias("_preset"),
        *[F.col(f).alias(f"_{f}") for f in fields],
    )
    out = with_store_id(df.join(preset, target, "left"), target, stores)
    types = dict(part.split() for part in PARAM_SCHEMA.split(", "))
    for f in fields:
        value = F.lit(getattr(defaults, f)).cast(types[f])
        if f == "store":
            value = F.coalesce("store_id", value)
        out = out.withColumn(f, F.when(F.col("_preset"), F.col(f"_{f}")).otherwise(value))
    return out.drop("_preset", "store_id", *[f"_{f}" for f in fields])


def extra_store(df: DataFrame, target: str, stores: DataFrame) -> DataFrame:
    """Add ``extra_store``: the store id where the target is a listed store, else null."""
    table = stores.select(F.col("name").alias(target), F.col("id").alias("extra_store"))
    return df.join(table, target, "left")


def title_query(title: Column | str, rules=None, default: str = fv.TITLE_DEFAULT) -> Column:
    """Query from the words of a widget title, first rule that fits."""
    c = F.col(title) if isinstance(title, str) else title
    ladder = None
    for words, query in fv.TITLE_WORDS if rules is None else rules:
        test = F.lit(True)
        for word in words:
            test = test & c.contains(word)
        ladder = F.when(test, query) if ladder is None else ladder.when(test, query)
    return ladder.otherwise(default)


def distinct_titles(df: DataFrame, title: str = "title", order: str = "ord") -> DataFrame:
    """Each title once, in the order of its first appearance; blank ones dropped."""
    return (
        df.filter(F.col(title).isNotNull() & (F.trim(title) != ""))
        .groupBy(title).agg(F.min(order).alias(order))
    )


def by_priority(df: DataFrame, page: str, sheet: str = "sheet") -> DataFrame:
    """Sheets in processing order; sheets without a place come last, by name."""
    places = {s: str(i + 1) for i, s in enumerate(fv.SHEET_PRIORITY[page])}
    place = lookup(sheet, places).cast("int")
    return df.withColumn("priority", place).orderBy(F.col("priority").asc_nulls_last(), sheet)


def target_params(title: str, target: str, stores: dict[str, str] | None = None) -> Params:
    """Parameters for one drill-through on the driver.

    Unlike a preset without a filter, the target is pinned in the dimension
    its widget shows, so the query covers what the sheet shows.
    """
    stores = stores or fv.STORE_IDS
    base = Params(year=fv.DRILL_PARAMS.get(target, {}).get("year", fv.DEFAULT_YEAR))
    store = stores.get(target) or (target if target.isdigit() else None)
    if store:
        return base.override(store=store)
    dimension = {
        "Top Brands by Sales": "brand",
        "Top Categories by Sales": "category",
        "Top Sub Categories by Sales": "sub_category",
        "Top Products by Sales": "product",
        "Weekly Trends": "year_week",
    }.get(title)
    return base.override(**{dimension: target}) if dimension else base
