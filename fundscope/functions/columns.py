"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from Spark's built-in functions, so
it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that results depend on (they must equal the original workload's)
# ---------------------------------------------------------------------------
# corrupt country value left behind by scraping
COUNTRY_SENTINEL = '"N'
# currency that does not identify a single country, and the label used instead
AMBIGUOUS_CURRENCY = "EUR"
UNKNOWN_COUNTRY = "Unknown"
# raw states merged into 'failed' and into 'other'; any other state is kept as it is
FAILED_STATES = ("failed", "canceled", "suspended")
OTHER_STATES = ("undefined", "live")
# the two merged states the rate analyses are about
SUCCESS = "successful"
FAILED = "failed"
OTHER = "other"
# placeholder year of broken launch dates
PLACEHOLDER_YEAR = 1970
# day-first text formats of the raw files: launched "dd/mm/yyyy hh:mm", deadline "dd/mm/yyyy"
# ---------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


DAY_FIRST_DATE = r"\d{1,2}/\d{1,2}/\d{4}"
DAY_FIRST_TIME = DAY_FIRST_DATE + r"\s+\d{1,2}:\d{1,2}"


def _parts(c: Column, n: int, shape: str) -> list[Column]:
    """Split day-first text into ``n`` integer parts (NULL parts unless the whole text has the shape).

    The split stays outside any conditional, so Spark evaluates it once per row;
    the shape only chooses the element index.
    """
    arr = F.split(F.trim(c), r"/|:|\s+")
    fits = c.rlike(rf"^\s*{shape}\s*$")
    return [F.try_element_at(arr, F.when(fits, F.lit(i + 1))).try_cast("int") for i in range(n)]


def parse_day_first_timestamp(c: str | Column) -> Column:
    """``dd/mm/yyyy hh:mm`` text -> TIMESTAMP_NTZ; NULL for text that is not a valid time.

    Slashes, blanks and the colon must stand where the format has them. One or two digits are
    accepted for day, month, hour and minute; a year has four (a two-digit year is bad text, not
    guessed). Built from the parts, so the result does not depend on the session time zone (no
    daylight-saving gaps) and bad text never raises under ANSI mode.
    """
    d, m, y, hh, mi = _parts(col(c), 5, DAY_FIRST_TIME)
    return F.try_make_timestamp_ntz(y, m, d, hh, mi, F.lit(0))


def parse_day_first_date(c: str | Column) -> Column:
    """``dd/mm/yyyy`` text -> DATE; NULL for invalid dates such as 31/04."""
    d, m, y = _parts(col(c), 3, DAY_FIRST_DATE)
    return F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def format_day_first(c: str | Column, with_time: bool = True) -> Column:
    """TIMESTAMP_NTZ / DATE -> ``dd/mm/yyyy[ hh:mm]`` text, from the value's own fields
    (no conversion through the session time zone)."""
    v = col(c)
    date = F.concat(_two(F.dayofmonth(v)), F.lit("/"), _two(F.month(v)), F.lit("/"),
                    F.lpad(F.year(v).cast("string"), 4, "0"))
    if not with_time:
        return date
    return F.concat(date, F.lit(" "), _two(F.hour(v)), F.lit(":"), _two(F.minute(v)))


def text_equals(c: str | Column, value: str, case_insensitive: bool = False) -> Column:
    """String equality; binary by default, or under the UTF8_LCASE collation
    (the case-insensitive comparison of the usual collations of SQL servers)."""
    v = col(c)
    if case_insensitive:
        v = F.collate(v, "UTF8_LCASE")
    return v == F.lit(value)


def merged_state(state: str | Column = "state") -> Column:
    """failed/canceled/suspended -> failed; undefined/live -> other; anything else unchanged."""
    s = col(state)
    return (F.when(s.isin(*FAILED_STATES), F.lit(FAILED))
            .when(s.isin(*OTHER_STATES), F.lit(OTHER))
            .otherwise(s))


def country_or_null(country: str | Column = "country", sentinel: str = COUNTRY_SENTINEL) -> Column:
    """The corrupt sentinel value becomes NULL."""
    c = col(country)
    return F.when(c != F.lit(sentinel), c)


def country_from_currency(currency: str | Column = "currency") -> Column:
    """Value written into a missing country: the first two letters of the currency,
    or ``Unknown`` when the currency is EUR or missing."""
    cur = col(currency)
    return (F.when(cur != F.lit(AMBIGUOUS_CURRENCY), F.substring(cur, 1, 2))
            .otherwise(F.lit(UNKNOWN_COUNTRY)))


def repaired_country(country: str | Column, currency: str | Column, sentinel: str = COUNTRY_SENTINEL) -> Column:
    """Country after the repair: kept when present, else guessed from the currency."""
    c = country_or_null(country, sentinel)
    return F.when(c.isNull(), country_from_currency(currency)).otherwise(c)


def half_up_scaled(num: str | Column, den: str | Column, scale: int) -> Column:
    """``round(num / den * 10**scale)``, ties away from zero, exact; BIGINT (NULL when den is 0).

    ``num`` and ``den`` must be integral. Integer arithmetic keeps the rounding
    independent of summation order and of binary floating point, so a decimal
    average or percentage is the same number on every engine.
    """
    n = col(num).cast("decimal(38,0)")
    d = col(den).cast("decimal(38,0)")
    an, ad = F.abs(n), F.abs(d)
    top = (an * F.lit(2 * 10 ** scale) + ad).cast("decimal(38,0)")
    # a zero denominator never reaches the division (ANSI mode would raise)
    bottom = F.when(ad == 0, F.lit(1)).otherwise(ad * F.lit(2)).cast("decimal(38,0)")
    magnitude = int_div(top, bottom)
    signed = F.when((n < 0) != (d < 0), -magnitude).otherwise(magnitude)
    return F.when(d != 0, signed)


def half_up_div(num: str | Column, den: str | Column, scale: int) -> Column:
    """``round(num / den, scale)``, ties away from zero, computed exactly; DOUBLE."""
    return half_up_scaled(num, den, scale).cast("double") / F.lit(float(10 ** scale))


def int_div(a: Column, b: Column) -> Column:
    """Exact integral quotient of non-negative integral decimals (``a div b``) as BIGINT.

    ``a - a % b`` is an exact multiple of ``b``, so the decimal division is exact.
    """
    return ((a - a % b) / b).cast("long")


def money_avg_half_up(c: str | Column, scale: int) -> Column:
    """Aggregate: mean of a money column (DECIMAL, or DOUBLE with up to 8 decimals), exact, rounded
    half-up to ``scale`` once, at the end; DOUBLE. The sum is a DECIMAL(38,8), so nothing is rounded
    per row and the result does not depend on the order of the rows."""
    total = F.sum(col(c).cast("decimal(28,8)"))
    return half_up_div((total * F.lit(10**8).cast("decimal(9,0)")).cast("decimal(38,0)"), F.count(col(c)) * F.lit(10**8), scale)
