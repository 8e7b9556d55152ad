"""Column-expression helpers. Everything here is a pure ``Column`` builder, so it
stays inside whole-stage codegen; no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float | None, hi: float | None) -> Column:
    """Clip into [lo, hi]; NULL stays NULL (``greatest`` alone would turn it into lo)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def is_bad(c) -> Column:
    """NaN or +-inf."""
    x = col(c)
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def nan_to_null(c) -> Column:
    """Normalise NaN / +-inf to NULL once, at the source."""
    x = col(c).cast("double")
    return F.when(is_bad(x), F.lit(None).cast("double")).otherwise(x)


def clean_num(c) -> Column:
    """NaN -> 0, +-inf -> 0, NULL -> 0 (the observed cleaning of every stage)."""
    x = col(c)
    x = x.cast("double")
    return F.coalesce(F.when(is_bad(x), F.lit(0.0)).otherwise(x), F.lit(0.0))


def clip_label(c, lo: int = 0, hi: int = 2) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def parse_seq(key) -> Column:
    """Integer after the first underscore of a key such as ``TRAIN_0012``.

    NULL when the key has no underscore or the piece is not an integer
    (``A_1.5``, ``A_``); surrounding blanks and a leading sign are accepted.
    """
    piece = F.try_element_at(F.split(col(key), "_"), F.lit(2))
    return piece.try_cast("bigint")


def parse_seq_or_zero(key) -> Column:
    return F.coalesce(parse_seq(key), F.lit(0).cast("bigint"))


def safe_div(a, b, default: float = 0.0) -> Column:
    """a / b with a guard for b = 0 (ANSI mode raises on division by zero)."""
    a, b = col(a), col(b)
    return F.when(b == 0, F.lit(default)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def argmax3(p0, p1, p2) -> Column:
    """Index of the largest of three; the first wins on ties."""
    a, b, c = col(p0), col(p1), col(p2)
    return (F.when((a >= b) & (a >= c), F.lit(0))
            .when(b >= c, F.lit(1)).otherwise(F.lit(2)))


def r6(c) -> Column:
    """Round to 6 decimals (the comparison precision of the SQL oracles). A value
    that is a tie but for the last bit goes up in either engine: the cut lies a
    ten-thousandth of a step below the tie."""
    d = col(c).cast("double")
    return F.when(F.abs(d) < 1e9, F.floor(d * 1e6 + 0.5001) / 1e6).otherwise(F.round(d, 6))


def sum_cols(cols) -> Column:
    return reduce(lambda x, y: x + y, [col(c) for c in cols])


def unpivot(df, id_cols: list[str], value_cols: list[str], var: str = "feature",
            val: str = "value"):
    """Long form (id..., feature, value) with every value cast to double."""
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols]) \
        .unpivot(id_cols, value_cols, var, val)


def safe_corr(x, y) -> Column:
    """Pearson correlation over rows where both are present; NULL (not an ANSI
    divide-by-zero error) when either side is constant."""
    a, b = col(x).cast("double"), col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    xa = F.when(both, a)
    yb = F.when(both, b)
    return F.try_divide(F.covar_samp(xa, yb), F.stddev_samp(xa) * F.stddev_samp(yb))
