"""Column expressions shared by the operators.  All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n and n not in df.columns]
    if missing:
        raise ValueError(f"no column(s) {missing}; available: {df.columns}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def finite(c: Column) -> Column:
    """A double with NaN and the infinities turned into null."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere: NaN in floating columns becomes null once, at load."""
    fixes = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixes) if fixes else df


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds, counting unknown as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# Period codes and the truncation unit of each; weeks start on Monday.
PERIOD_UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def period(c: Column, freq: str) -> Column:
    """First date of the period that holds a time."""
    if freq not in PERIOD_UNITS:
        raise ValueError(f"freq must be one of {list(PERIOD_UNITS)}")
    day = F.to_date(c.cast("timestamp"))   # dates are cut faster than times
    return day if freq == "D" else F.trunc(day, PERIOD_UNITS[freq])


def pearson_sums(x: Column, y: Column, prefix: str = "") -> list[Column]:
    """The sums a correlation needs, over rows where both values are known."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    return [F.count(a).alias(f"{prefix}n"), F.sum(a).alias(f"{prefix}sx"), F.sum(b).alias(f"{prefix}sy"),
            F.sum(a * a).alias(f"{prefix}sxx"), F.sum(b * b).alias(f"{prefix}syy"), F.sum(a * b).alias(f"{prefix}sxy")]


def pearson(prefix: str = "", min_n: int = 2) -> Column:
    """Correlation from :func:`pearson_sums`; null when either side does not vary."""
    n, sx, sy = F.col(f"{prefix}n"), F.col(f"{prefix}sx"), F.col(f"{prefix}sy")
    cov = F.col(f"{prefix}sxy") - safe_div(sx * sy, n)
    vx = F.col(f"{prefix}sxx") - safe_div(sx * sx, n)
    vy = F.col(f"{prefix}syy") - safe_div(sy * sy, n)
    # below a relative 1e-12 a sum of squares is rounding, not variation
    varies = (vx > F.abs(F.col(f"{prefix}sxx")) * 1e-12) & (vy > F.abs(F.col(f"{prefix}syy")) * 1e-12)
    return F.when((n >= min_n) & varies, safe_div(cov, safe_sqrt(vx) * safe_sqrt(vy)))


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness (the built-in is the population one)."""
    n = F.count(x).cast("double")
    return F.when(F.count(x) > 2, F.skewness(x) * safe_sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(F.count(x) > 3,
                  safe_div((n - 1), (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def rolling(agg, x: Column, by: Sequence[str], order: Sequence[str], start: int, end: int, least: int) -> Column:
    """An aggregate over a frame of records, null with fewer than ``least`` known values.

    Use on frames with one row per (entity, date), where the calendar bounds an entity's partition.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(start, end)
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


# Identifier forms, in priority order.
IDENTIFIER_FORMS = (
    (r"^[A-Z]{1,5}$", "letters only (1-5)"),
    (r"^[A-Z]{6,}$", "letters only (6+)"),
    (r"^[A-Z]+[a-z][A-Z]?$", "lower-case class letter (e.g. ABCpA)"),
)
IDENTIFIER_SEPARATORS = ("/", ".", "-")


def identifier_class(c: Column) -> Column:
    """The written form of an identifier; the first form that fits wins."""
    s = c.cast("string")
    out = None
    for pattern, label in IDENTIFIER_FORMS:
        out = F.when(s.rlike(pattern), label) if out is None else out.when(s.rlike(pattern), label)
    for sep in IDENTIFIER_SEPARATORS:
        suffix = F.upper(F.substr(s, F.instr(s, sep) + F.lit(len(sep))))
        out = out.when(F.contains(s, F.lit(sep)), F.concat(F.lit(f"suffix after '{sep}': "), suffix))
    return out.when(s.rlike(r"\d"), "contains digits").otherwise("other")


def tokens(c: Column) -> Column:
    """Lower-cased ASCII word tokens in order; an identifier with underscores also yields its parts."""
    words = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))
    def expand(t):
        low = F.lower(t)
        parts = F.filter(F.split(low, "_"), lambda p: p != "")
        return F.when(F.contains(low, F.lit("_")), F.concat(F.array(low), parts)).otherwise(F.array(low))
    return F.flatten(F.transform(words, expand))


def hurdle(n_tests: Column) -> Column:
    """t a discovery must clear after n distinct tests: the larger of 3 and sqrt(2 ln n)."""
    n = F.greatest(n_tests, F.lit(1)).cast("double")
    return F.greatest(F.lit(3.0), F.sqrt(2 * F.log(n)))


def significance(t: Column, bar: Column) -> Column:
    return (F.when(t.isNull(), "no estimate")
            .when(F.abs(t) >= bar, "clears the hurdle")
            .when(F.abs(t) >= 2, "|t| >= 2 but below the hurdle")
            .otherwise("not distinguishable from zero"))
