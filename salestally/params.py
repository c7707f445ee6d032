"""Query parameters: period, scope and the pinned drill-through dimension."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally import fixed_values as fv


@dataclass(frozen=True)
class Params:
    """Filters of a query. ``None`` means no restriction.

    The first seven are the filters of a dashboard; the last six pin one
    value of a dimension for a drill-through: ``week`` a week of the month,
    ``year_week`` a week of the year.
    """

    year: int | None = None
    month: int | None = None
    store: str | None = None
    state: str | None = None
    channel: str | None = None
    fromdate: date | None = None
    todate: date | None = None
    brand: str | None = None
    category: str | None = None
    sub_category: str | None = None
    product: str | None = None
    week: str | None = None
    year_week: str | None = None

    def override(self, **extra) -> "Params":
        """These parameters with the given ones replaced; ``None`` keeps the base."""
        return replace(self, **{k: v for k, v in extra.items() if v is not None})

    def fresh(self, as_of: date) -> "Params":
        """Without dates, look at the year and month of ``as_of``."""
        if self.fromdate or self.todate:
            return self
        return replace(self, year=as_of.year, month=as_of.month)

    def period(self) -> tuple[date | None, date | None]:
        """Half-open range of days, so that the scan can prune on it."""
        start = stop = None
        if self.year is not None:
            start, stop = date(self.year, 1, 1), date(self.year + 1, 1, 1)
            if self.month is not None:
                start = date(self.year, self.month, 1)
                if self.month < 12:
                    stop = date(self.year, self.month + 1, 1)
        if self.fromdate is not None:
            start = max(filter(None, (start, self.fromdate)))
        if self.todate is not None:
            stop = min(filter(None, (stop, self.todate + timedelta(days=1))))
        return start, stop

    def previous_year(self) -> "Params":
        """The same filters one year earlier."""
        if self.year is None and self.fromdate is None and self.todate is None:
            raise ValueError("a comparison with the previous year needs a year or dates")

        def back(day: date | None) -> date | None:
            if day is None:
                return None
            if (day.month, day.day) == (2, 29):
                return date(day.year - 1, 2, 28)
            return day.replace(year=day.year - 1)

        return replace(
            self, year=None if self.year is None else self.year - 1, fromdate=back(self.fromdate), todate=back(self.todate)
        )

    def as_row(self) -> tuple:
        return tuple(getattr(self, f) for f in fv.PARAM_FIELDS)


def default_params() -> Params:
    return Params(year=fv.DEFAULT_YEAR)


def in_period(params: Params, day: Column) -> Column | None:
    """Predicate over the raw date column, or None without date filters.

    The column is compared with literals of the column's own type: a cast on
    the column would keep the predicate out of the scan.
    """
    start, stop = params.period()
    tests = []
    if start is not None:
        tests.append(day >= F.lit(start.isoformat()).cast("timestamp_ntz"))
    if stop is not None:
        tests.append(day < F.lit(stop.isoformat()).cast("timestamp_ntz"))
    if params.month is not None and params.year is None:
        tests.append(F.month(day) == params.month)
    return all_of(tests)


def in_week(params: Params, day: Column) -> Column | None:
    """Days of the pinned week of the month or year (Week1 = days 1 to 7)."""
    tests = []
    for label, last, place in ((params.week, 5, F.dayofmonth), (params.year_week, 53, F.dayofyear)):
        if label is not None:
            found = re.fullmatch(r"Week([0-9]{1,2})", label)
            number = int(found.group(1)) if found else 0
            if not 1 <= number <= last:
                raise ValueError(f"no week from Week1 to Week{last}: {label}")
            tests.append(place(day).between(7 * number - 6, 7 * number))
    return all_of(tests)


def all_of(tests: list[Column | None]) -> Column | None:
    out = None
    for test in tests:
        if test is not None:
            out = test if out is None else out & test
    return out


# --- parameters as data ---------------------------------------------------

PARAM_SCHEMA = (
    "year int, month int, store string, state string, channel string, fromdate date, todate date"
)


def validated(df: DataFrame, year_range=fv.YEAR_RANGE, month_range=fv.MONTH_RANGE,
              store_max_length: int = fv.STORE_MAX_LENGTH) -> DataFrame:
    """Add ``valid`` to a table of parameters. Null parameters are fine."""

    def passes(test: Column) -> Column:
        return F.coalesce(test, F.lit(True))

    return df.withColumn(
        "valid",
        passes(F.col("year").between(*year_range))
        & passes(F.col("month").between(*month_range))
        & passes(F.length("store") <= store_max_length),
    )


def valid(params: Params, **bounds) -> bool:
    """The same rules for one set of parameters on the driver."""
    low, high = bounds.get("year_range", fv.YEAR_RANGE)
    first, last = bounds.get("month_range", fv.MONTH_RANGE)
    length = bounds.get("store_max_length", fv.STORE_MAX_LENGTH)
    if params.year is not None and not (isinstance(params.year, int) and low <= params.year <= high):
        return False
    if params.month is not None and not (isinstance(params.month, int) and first <= params.month <= last):
        return False
    return params.store is None or (isinstance(params.store, str) and len(params.store) <= length)


def from_mapping(values: dict) -> Params:
    known = {f.name for f in fields(Params)}
    return Params(**{k.lower(): v for k, v in values.items() if k.lower() in known})
