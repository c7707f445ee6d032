"""Compare exported values with query results, key by key.

All lookups are left equi-joins in which the database side is unique per key.
A hot key on the export side ("Unknown" can be a third of the rows) is split
by AQE, which can do so only when an exchange stands directly below the join.
Aggregating the database side on the join keys themselves would remove that
exchange, so ``last_wins`` and ``pivot_metrics`` group by the keys packed in a
struct and unpack them after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salestally import fixed_values as fv
from salestally.functions.names import compare_key, kpi_key, squash, without_sales_suffix
from salestally.functions.values import comparable

KEYS = ["sheet", "identifier", "metric"]


# --- one value per key -------------------------------------------------------------


def last_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value with the highest order per key; equal orders go to the greater value."""
    return (
        df.groupBy(F.struct(*keys).alias("key"))
        .agg(F.max_by(value, F.struct(order, value)).alias(value))
        .select(*[F.col(f"key.{k}").alias(k) for k in keys], value)
    )


def override_union(parts: list[DataFrame]) -> DataFrame:
    """Cells of several queries; a later query overrides an earlier one."""
    tagged = [part.withColumn("src_ord", F.lit(i)) for i, part in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return last_wins(out, KEYS, "value", "src_ord")


# --- KPIs -------------------------------------------------------------------------------


def reconcile_kpis(export: DataFrame, db: DataFrame, numeric: bool = False) -> DataFrame:
    """KPI by KPI: values as text, status and note.

    export: kpi_name, value_raw and, where names repeat, ord (the last wins).
    db: kpi_name, value. With ``numeric`` values are compared as amounts. A
    value that is null is compared as the text it is printed with.
    """
    order = "ord" if "ord" in export.columns else "value_raw"
    text = export.withColumn("value_raw", F.coalesce("value_raw", F.lit(fv.NULL_TEXT)))
    left = last_wins(text, ["kpi_name"], "value_raw", order)
    right = last_wins(
        db.select(kpi_key("kpi_name").alias("lookup"), F.coalesce("value", F.lit(fv.NULL_TEXT)).alias("value")),
        ["lookup"], "value", "value",
    )
    joined = left.withColumn("lookup", kpi_key("kpi_name")).join(right, "lookup", "left")
    found = F.coalesce("value", F.lit(fv.NOT_FOUND))
    if numeric:
        equal = comparable("value_raw") == comparable(found)
    else:
        equal = F.col("value_raw") == found
    status = notes = None
    for text, name, note in fv.KPI_SENTINELS:
        test = found == text
        status = F.when(test, name) if status is None else status.when(test, name)
        notes = F.when(test, note) if notes is None else notes.when(test, note)
    return joined.select(
        "kpi_name", F.col("value_raw").alias("excel_value"), found.alias("db_value"),
        status.when(equal, "Match").otherwise("Mismatch").alias("status"),
        notes.when(equal, fv.KPI_MATCH_NOTE).otherwise(fv.KPI_MISMATCH_NOTE).alias("notes"),
    )


# --- long reports -------------------------------------------------------------------------


def _fallback_values(db: DataFrame, name: str, forms: list[tuple[str, Column]]) -> DataFrame:
    """Value per (lookup, metric) over several (sheet, lookup text) forms, first form wins.

    The forms are taken on the database side, so that the export side is
    looked up by a single equality and never multiplied.
    """
    tries = F.array_compact(F.array(*[
        F.when((F.col("sheet") == sheet) & lookup.isNotNull(),
               F.struct(lookup.alias("lookup"), F.lit(i).alias("i")))
        for i, (sheet, lookup) in enumerate(forms)
    ]))
    sheets = sorted({sheet for sheet, _ in forms})
    return (
        db.filter(F.col("sheet").isin(sheets))
        .select("metric", "value", F.explode(tries).alias("t"))
        .groupBy(F.struct(F.col("t.lookup").alias("lookup"), "metric").alias("key"))
        .agg(F.min_by("value", "t.i").alias(name))
        .select(F.col("key.lookup").alias("lookup"), F.col("key.metric").alias("metric"), name)
    )


def with_weekly_fallbacks(left: DataFrame, db: DataFrame) -> DataFrame:
    """Add ``fallback``: the value under the weekly sheets' other names.

    Tried in order: the identifier in the weekly sheet, in the weekday sheet,
    then without its suffix in the weekly sheet, then with the suffix put back.
    """
    same = F.col("identifier")
    base = F.when(
        F.col("identifier").endswith(fv.SALES_SUFFIX),
        F.expr(f"left(identifier, length(identifier) - {len(fv.SALES_SUFFIX)})"),
    )
    by_name = _fallback_values(
        db, "by_name", [(fv.WEEKLY_ALIAS_SHEET, same), (fv.WEEKDAY_SHEET, same)]
    )
    by_base = _fallback_values(
        db, "by_base", [(fv.WEEKLY_ALIAS_SHEET, same), (fv.WEEKLY_ALIAS_SHEET, base)]
    ).withColumnRenamed("lookup", "base")
    return (
        left.withColumn("lookup", F.col("identifier"))
        .withColumn("base", without_sales_suffix("identifier"))
        .join(by_name, ["lookup", "metric"], "left")
        .join(by_base, ["base", "metric"], "left")
        .withColumn("fallback", F.coalesce("by_name", "by_base"))
        .drop("lookup", "base", "by_name", "by_base")
    )


def reconcile_long(export: DataFrame, db: DataFrame, missing_status: str = "Mismatch",
                   weekly_fallbacks: bool = False, scale_suffix: bool = False,
                   route: str = "sheet") -> DataFrame:
    """Row by row: the exported value, the database value and a status.

    export: sheet, row_ord, identifier, metric, value_raw. db: sheet,
    identifier, metric, value, unique per key (see ``override_union``).
    ``route`` is the column of ``export`` that names a row's sheet in ``db``, where that is
    another than its own; a null one leads nowhere.
    """
    db = db.select(*KEYS, "value")
    joined = export.join(db.withColumnRenamed("sheet", route), [route, "identifier", "metric"], "left")
    value = F.col("value")
    if weekly_fallbacks:
        joined = with_weekly_fallbacks(joined, db)
        value = F.coalesce("value", "fallback")
    exported = comparable("value_raw", scale_suffix)
    stored = comparable(value, scale_suffix)
    status = (
        F.when(value.isNull(), missing_status)
        .when(exported == stored, "Match")
        .otherwise("Mismatch")
    )
    return joined.select(
        "sheet", "row_ord", "identifier", "metric",
        exported.alias("excel_value"),
        F.coalesce(stored, F.lit(fv.NOT_FOUND)).alias("db_value"),
        status.alias("status"),
    )


def first_hit(left: DataFrame, keys: Column, db: DataFrame, row_key: list[str]) -> DataFrame:
    """Look up an ordered array of keys per row; the first key that exists wins.

    db: key, value. The general form; ``with_weekly_fallbacks`` is cheaper for
    forms known beforehand.
    """
    tries = left.select(*row_key, F.posexplode_outer(keys).alias("pos", "key"))
    hits = (
        tries.join(db.select("key", "value"), "key", "left")
        .groupBy(F.struct(*row_key).alias("row"))
        .agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("pos"))).alias("value"))
        .select("row.*", "value")
    )
    return left.join(hits, row_key, "left")


# --- wide reports ---------------------------------------------------------------------------


def pivot_metrics(db: DataFrame, metrics: list[str]) -> DataFrame:
    """One column per metric, one row per (sheet, identifier)."""
    wanted = db.filter(F.col("metric").isin(metrics))
    return (
        wanted.groupBy(F.struct("sheet", "identifier").alias("key"))
        .agg(*[
            F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"DB {m}") for m in metrics
        ])
        .select("key.*", *[F.col(f"`DB {m}`") for m in metrics])
    )


def reconcile_wide(export: DataFrame, db: DataFrame, metrics: list[str], route: str = "sheet") -> DataFrame:
    """The sheet's own layout with the database value and a status per measure.

    export: sheet, row_ord, identifier and one text column per metric. Values
    are shown as they are; they are compared rounded. An empty exported cell
    counts as a match and is marked as not compared. ``route`` as in ``reconcile_long``.
    """
    side = pivot_metrics(db, metrics).withColumnRenamed("sheet", route)
    joined = export.join(side, [route, "identifier"], "left")
    out = [F.col("sheet"), F.col("row_ord"), F.col("identifier")]
    compared = F.lit(True)
    for m in metrics:
        mine, theirs = F.col(f"`{m}`"), F.col(f"`DB {m}`")
        status = (
            F.when(mine.isNull(), "Match")
            .when(theirs.isNull(), fv.NOT_FOUND)
            .when(comparable(mine) == comparable(theirs), "Match")
            .otherwise("Mismatch")
        )
        compared = compared & mine.isNotNull()
        out += [
            mine.alias(f"Excel {m}"),
            F.coalesce(theirs, F.lit(fv.NOT_FOUND)).alias(f"DB {m}"),
            status.alias(f"{m} Status"),
        ]
    return joined.select(*out, compared.alias("compared"))


# --- keys on either side ------------------------------------------------------------------------


def key_sides(export: DataFrame, db: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each key once, with the sides it occurs on.

    A union with a flag and one aggregation: repeated keys are combined before
    the shuffle, which a full outer join could not do.
    """
    both = export.select(*keys, F.lit(1).alias("flag")).unionByName(
        db.select(*keys, F.lit(2).alias("flag"))
    )
    side = F.element_at(F.array(F.lit("export_only"), F.lit("db_only"), F.lit("common")), F.col("flags"))
    return both.groupBy(*keys).agg(F.bit_or("flag").alias("flags")).select(*keys, side.alias("side"))


def key_side_counts(sides: DataFrame) -> DataFrame:
    return sides.agg(*[
        F.count_if(F.col("side") == s).alias(s) for s in ("common", "export_only", "db_only")
    ])


def key_side_sample(sides: DataFrame, side: str, n: int = 3) -> DataFrame:
    return sides.filter(F.col("side") == side).drop("side").orderBy(*[c for c in sides.columns if c != "side"]).limit(n)


def common_keys(export: DataFrame, db: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return key_sides(export, db, keys).filter("side = 'common'").drop("side")


def keys_missing_from(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys of the left side that the right side lacks."""
    return key_sides(left, right, keys).filter("side = 'export_only'").drop("side")


def equal_preview(export: DataFrame, db: DataFrame, n: int = 3) -> DataFrame:
    """First common keys with both raw texts and whether they are the same."""
    return (
        export.select(*KEYS, "value_raw").join(db.select(*KEYS, "value"), KEYS)
        .select(*KEYS, "value_raw", "value", F.col("value_raw").eqNullSafe(F.col("value")).alias("equal"))
        .orderBy(*KEYS).limit(n)
    )


def first_keys(cells: DataFrame, n: int = 10) -> DataFrame:
    """The first keys in order, and how many more there are: (ord, text)."""
    keys = cells.select(compare_key("sheet", "identifier", "metric").alias("text")).distinct()
    first = keys.orderBy("text").limit(n).select(F.lit(0).alias("ord"), "text")
    more = keys.agg((F.count(F.lit(1)) - n).alias("more")).filter("more > 0").select(
        F.lit(1).alias("ord"), F.format_string("... and %d more keys", "more").alias("text")
    )
    return first.unionByName(more)


GRAM = 3  # letters of a gram in the index of keys


def _grams(text: str, size: Column) -> Column:
    """The distinct substrings of a size; a text that is shorter has none, and every text has the empty one."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda start: F.substring(F.col(text), start, size)))


def near_keys(missing: DataFrame, db: DataFrame, n: int = 3) -> DataFrame:
    """For identifiers without a hit: the first keys that contain them.

    missing: identifier. db: cells. Keys are indexed by their grams of three letters (of fewer
    where an identifier is shorter). An identifier asks the index for one gram only, the one
    that the fewest keys have, and what that gives is compared with it. Each task keeps the first keys
    of an identifier before rows move, so a text that all keys share costs a few rows per task.
    """
    wanted = missing.select("identifier").distinct().where(F.col("identifier").isNotNull())
    keys = db.select(compare_key("sheet", "identifier", "metric").alias("near_key")).distinct().where(F.col("near_key").isNotNull())
    size = F.least(F.length("identifier"), F.lit(GRAM))
    asked = wanted.withColumn("gram", F.explode(_grams("identifier", size)))
    # only sizes that are asked for are indexed: four numbers at most
    sizes = sorted(r.size for r in wanted.select(size.alias("size")).distinct().collect())
    if not sizes:
        return keys.select("near_key", F.lit("").alias("identifier"), F.lit(0).alias("rank")).limit(0)
    index = keys.select("near_key", F.explode(F.flatten(F.array(*[_grams("near_key", F.lit(s)) for s in sizes]))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("keys"))
    rarest = asked.join(counts, "gram", "left").groupBy("identifier").agg(
        F.min_by("gram", F.struct(F.coalesce("keys", F.lit(0)), "gram")).alias("gram"))
    hits = index.join(rarest, "gram").where(F.contains(F.col("near_key"), F.col("identifier")))
    rank = F.row_number().over(Window.partitionBy("identifier").orderBy("near_key"))
    return hits.select("near_key", "identifier").withColumn("rank", rank).filter(F.col("rank") <= n)


# --- names of sheets ------------------------------------------------------------------------------


def sheet_widget(sheet: Column, widgets: list[str]) -> Column:
    """Widget name of a sheet: the equal name, else the first one it contains.

    The widget names are a short fixed list, so this is an expression over
    the sheet's name and no join.
    """
    name = squash(sheet)
    table = F.array(*[F.struct(squash(F.lit(w)).alias("key"), F.lit(w).alias("widget")) for w in widgets])
    equal = F.filter(table, lambda t: t["key"] == name)
    part = F.filter(table, lambda t: F.contains(name, t["key"]))
    return F.coalesce(F.get(equal, F.lit(0))["widget"], F.get(part, F.lit(0))["widget"])
