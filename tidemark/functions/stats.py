"""Column expressions with the null and tie rules that panel statistics need."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities: a missing value is null and nothing else."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_corr(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation over complete pairs; null for zero variance or a single pair."""
    both = col(x).isNotNull() & col(y).isNotNull()
    x, y = F.when(both, col(x)), F.when(both, col(y))
    parts = [F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.try_divide(parts[0], F.sqrt(parts[1] * parts[2]))


def average_rank(value: Column | str, *by: Column | str) -> Column:
    """Rank from 1 in ascending order within ``by``; ties share their mean rank."""
    value = col(value)
    within = Window.partitionBy(*by)
    return F.rank().over(within.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def ordinal_rank(value: Column | str, entity: Column | str, *by: Column | str) -> Column:
    """Rank from 1 in ascending order within ``by``; ties go by entity."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(col(value), col(entity)))


def descending_percentile(value: Column | str, entity: Column | str, *by: Column | str) -> Column:
    """1 for the largest, 0 for the smallest; ties go by entity; 1 if alone."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(col(value).desc(), col(entity)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.coalesce(F.try_divide((n - place).cast("double"), (n - 1).cast("double")), F.lit(1.0))


def growth_log(r: Column | str) -> Column:
    """log(1 + r); a loss of all or more counts as all but 1e-9."""
    return F.log(F.greatest(1 + col(r), F.lit(1e-9)))


def signed_log(c: Column | str) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def month_index(d: Column | str) -> Column:
    """Months since year 0; months are then integers with plain arithmetic."""
    return (F.year(col(d)) * 12 + F.month(col(d)) - 1).cast("int")


def mean_available(*columns: Column | str) -> Column:
    """Mean of the columns that aren't null; null if all are."""
    cs = [col(c) for c in columns]
    return ratio(sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0)), sum((c.isNotNull().cast("int") for c in cs), F.lit(0)))


def weighted_available(weights: dict[str, float]) -> Column:
    """Weighted mean with the weights of the columns that aren't null, scaled to one."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return ratio(top, sum((F.when(F.col(c).isNotNull(), abs(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0)))
