"""Which query does an unknown sheet come from? Profiles, scores, best match.

Sheets are rows; the queries to choose from are a short fixed list, held in
each expression as an array. Scoring is therefore a projection over sheets:
no pairs are formed and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.functions.names import header_text, letters_and_digits

# --- profiles of sheets -----------------------------------------------------------


def header_tags(headers: Column) -> Column:
    """Tags of a header list; ``generic_data`` when none applies."""
    text = F.lower(F.array_join(headers, " "))
    tags = F.array_compact(F.array(*[
        F.when(text.rlike("|".join(words)), F.lit(tag)) for tag, words in fv.HEADER_TAGS
    ]))
    return F.when(F.size(tags) == 0, F.array(F.lit(fv.NO_TAG))).otherwise(tags)


def _places(headers: Column, test) -> Column:
    found = F.transform(headers, lambda h, i: F.when(test(h), i))
    return F.filter(found, lambda i: i.isNotNull())


def _last(headers: Column, test) -> Column:
    """Position of the last header that passes, null if none does."""
    return F.try_element_at(_places(headers, test), F.lit(-1))


def _first(headers: Column, test) -> Column:
    return F.try_element_at(_places(headers, test), F.lit(1))


def key_columns(headers: Column) -> Column:
    """Position among the headers per role, a struct with null for absent roles.

    A header that says identifier wins; failing that the first one that names
    an entity. For the other roles the last fitting header counts, as when the
    headers are read from left to right.
    """
    def has(word):
        return lambda h: h.contains(word)

    def either(h):
        return h.rlike("name|product|brand|store|employee")

    def plain_sales(h):
        return h.contains("sales") & ~h.contains("actual sales")

    roles = {
        "identifier": F.coalesce(_last(headers, has("identifier")), _first(headers, either)),
        "actual_sales": _last(headers, has("actual sales")),
        "sales": _last(headers, plain_sales),
        "target": _last(headers, has("target")),
        "current_year": _last(headers, has("current year")),
        "previous_year": _last(
            headers, lambda h: h.contains("previous year") & ~h.contains("current year")
        ),
        "metric": _last(headers, has("metric")),
        "excel_value": _last(
            headers, lambda h: h.contains("excel value") & ~h.contains("metric")
        ),
    }
    return F.struct(*[place.alias(role) for role, place in roles.items()])


KEY_ROLES = ["identifier", "actual_sales", "sales", "target", "current_year", "previous_year",
             "metric", "excel_value"]


def has_key_columns() -> Column:
    return F.coalesce(*[F.col(f"key_columns.{role}") for role in KEY_ROLES]).isNotNull()


def suggestions(sheet: Column, headers: Column) -> Column:
    """Queries whose pattern fits "sheet name + headers", with a confidence."""
    text = F.lower(F.concat_ws(" ", sheet, F.array_join(headers, " ")))
    found = F.array_compact(F.array(*[
        F.when(
            text.rlike(pattern),
            F.struct(F.lit(query).alias("sp_name"), F.lit(fv.PATTERN_CONFIDENCE).alias("confidence")),
        )
        for pattern, query in fv.NAME_PATTERNS
    ]))
    word, query, confidence = fv.FALLBACK_SUGGESTION
    fallback = F.array(
        F.struct(F.lit(query).alias("sp_name"), F.lit(confidence).alias("confidence"))
    )
    return F.when((F.size(found) == 0) & text.contains(word), fallback).otherwise(found)


def sheet_profiles(sheets: DataFrame) -> DataFrame:
    """Profile of each sheet.

    ``sheets`` has one row per sheet: sheet, headers (array), data_volume and,
    if known, samples. See ``sources.exports.sheet_shapes``.
    """
    headers = F.transform("headers", header_text)
    return (
        sheets.withColumn("headers", headers)
        .withColumn("normalized_name", letters_and_digits("sheet"))
        .withColumn("data_patterns", header_tags(F.col("headers")))
        .withColumn("key_columns", key_columns(F.col("headers")))
        .withColumn("suggested_sps", suggestions(F.col("sheet"), F.col("headers")))
    )


# --- shapes of query results --------------------------------------------------------

_SHAPE_RULES = [
    (["metric", "value"], "metric_value_pairs"),
    (["month", "currentyearsales"], "monthly_trends"),
    (["week", "currentyearsales"], "weekly_trends"),
    (["daytype|weekcategory", "sales"], "weekday_weekend"),
    (["productname", "sales"], "product_sales"),
    (["brandname", "sales"], "brand_sales"),
    (["store", "sales"], "store_sales"),
    (["identifier", "actual|target"], "store_sales"),
    (["employeename", "sales"], "employee_performance"),
    (["category", "sales"], "category_sales"),
]


def output_shape(columns: Column) -> Column:
    """Shape of a result from its column names, first rule that fits."""
    text = F.lower(F.array_join(columns, " "))
    ladder = None
    for words, shape in _SHAPE_RULES:
        test = F.lit(True)
        for word in words:
            test = test & text.rlike(word)
        ladder = F.when(test, shape) if ladder is None else ladder.when(test, shape)
    generic = (F.size(columns) >= 2) & text.rlike("sales|actual|value")
    return ladder.when(generic, "generic_sales").otherwise("generic")


def output_shape_of(columns: list[str]) -> str:
    """The same rule for a column list known on the driver."""
    text = " ".join(columns).lower()
    for words, shape in _SHAPE_RULES:
        if all(any(option in text for option in word.split("|")) for word in words):
            return shape
    generic = len(columns) >= 2 and any(w in text for w in ("sales", "actual", "value"))
    return "generic_sales" if generic else "generic"


# --- scores -------------------------------------------------------------------------

# A probed query: (ord, name, shape, row_count, columns). One per catalogue entry.
Found = tuple[int, str, str, int, list[str]]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def _direct(sheet: Column, has_target: Column, query: str, rules) -> Column:
    """Whether a name rule joins a sheet with this query."""
    usual = _any([sheet.contains(words) for words, name in rules if name in query])
    words, name = fv.TARGET_SHEET_NAME
    special = sheet.contains(words) & has_target
    return F.when(special, F.lit(name in query)).otherwise(usual)


def _boost(sheet: Column, has_target: Column, query: str, boosts) -> Column:
    """Points of the first boost for this query whose words fit the sheet."""
    ladder = None
    for name, present, absent, target, tenths in boosts:
        if name not in query:
            continue
        test = F.lit(True)
        for word in present:
            test = test & sheet.contains(word)
        for word in absent:
            test = test & ~sheet.contains(word)
        if target != "any":
            test = test & (has_target if target == "yes" else ~has_target)
        ladder = F.when(test, tenths) if ladder is None else ladder.when(test, tenths)
    return F.lit(0) if ladder is None else ladder.otherwise(0)


def _points(test: Column, tenths: int) -> Column:
    return F.when(test, F.lit(tenths)).otherwise(F.lit(0))


def score_all(profiles: DataFrame, found: list[Found], rules=None, boosts=None) -> DataFrame:
    """Add ``scores``: per query a (tenths, -ord, name, shape) struct.

    Scores are whole tenths, so equal scores are equal. ``rules`` and
    ``boosts`` replace the fixed name rules and the fixed boosts.
    """
    rules = fv.DIRECT_NAMES if rules is None else rules
    boosts = fv.SCORE_BOOSTS if boosts is None else boosts
    sheet = F.lower("sheet")
    tags = F.col("data_patterns")
    has_target = F.array_contains(tags, "target_data")
    has_keys = has_key_columns()

    def scored(ord_: int, query: str, shape: str, rows: int, columns: list[str]) -> Column:
        expected = fv.EXPECTED_TAGS.get(shape, [])
        total = (
            _points(_direct(sheet, has_target, query, rules), fv.SCORE_DIRECT)
            + _points(F.arrays_overlap(F.array(*[F.lit(t) for t in expected]), tags)
                      if expected else F.lit(False), fv.SCORE_TAGS)
            + _boost(sheet, has_target, query, boosts)
            + F.lit(fv.SCORE_VOLUME if rows else 0)
            + _points(has_keys, fv.SCORE_COLUMNS if columns else 0)
        )
        return F.struct(
            F.least(total, F.lit(fv.SCORE_CAP)).alias("tenths"), F.lit(-ord_).alias("first"),
            F.lit(query).alias("sp_name"), F.lit(shape).alias("output_pattern"),
        )

    return profiles.withColumn("scores", F.array(*[scored(*q) for q in found]))


def best_match(scored: DataFrame, floor: int = fv.SCORE_FLOOR) -> DataFrame:
    """The best query per sheet; equal scores go to the earlier query.

    Sheets whose best score does not exceed the floor are left out.
    """
    best = F.array_max("scores")
    return (
        scored.withColumn("best", best)
        .filter(F.col("best.tenths") > floor)
        .select(
            "sheet",
            F.col("best.sp_name").alias("sp_name"),
            (F.col("best.tenths") / 10).alias("confidence"),
            F.col("best.output_pattern").alias("output_pattern"),
            F.size(F.filter("scores", lambda s: s["tenths"] == F.col("best.tenths"))).alias("ties"),
            "key_columns",
            "data_patterns",
        )
    )


def match_sheets(sheets: DataFrame, found: list[Found], rules=None, boosts=None) -> DataFrame:
    """Profile, score and choose in one projection over the sheets."""
    return best_match(score_all(sheet_profiles(sheets), found, rules, boosts))
