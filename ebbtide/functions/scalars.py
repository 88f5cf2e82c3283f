"""Column expressions: text, ids, ratios, bins and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide import fixed_values as fv


def normalize_columns(df: DataFrame, aliases: Mapping[str, str] = fv.RAW_ALIASES) -> DataFrame:
    """Trim and lower-case headers, blanks and dashes to ``_``, then apply the aliases."""
    tidy = [name.strip().lower().replace(" ", "_").replace("-", "_") for name in df.columns]
    return df.toDF(*[aliases.get(name, name) for name in tidy])


def with_line_amount(df: DataFrame, price: str = "price") -> DataFrame:
    return df.withColumn("line_amount", F.col("quantity") * F.col(price))


def canonical_id(value: Column, how: str = "strip") -> Column:
    """Customer id as text.

    ``strip`` removes one trailing ``.0``; ``numeric`` goes through an exact decimal, so every
    whole number of up to 18 digits keeps its digits and text that is no number becomes NULL;
    ``text`` only casts.
    """
    if how == "strip":
        return F.regexp_replace(value.cast("string"), r"\.0$", "")
    if how == "numeric":
        return value.cast("string").try_cast("decimal(38, 6)").try_cast("bigint").cast("string")
    if how == "text":
        return value.cast("string")
    raise ValueError(f"unknown id conversion: {how}")


def is_cancel(invoice_no: Column) -> Column:
    return F.coalesce(invoice_no.cast("string").startswith(fv.CANCEL_PREFIX), F.lit(False))


def is_special_stock(
    code: Column,
    codes: Sequence[str] = fv.SPECIAL_CODES,
    prefixes: Sequence[str] = fv.SPECIAL_PREFIXES,
) -> Column:
    """Not a product: an exact code (as written) or a prefix (in any case)."""
    text = F.trim(code.cast("string"))
    hit = text.isin(list(codes))
    for prefix in prefixes:
        hit = hit | F.upper(text).startswith(prefix.upper())
    return F.coalesce(hit, F.lit(False))


def flag_rows(df: DataFrame, price: str = "price") -> DataFrame:
    return df.withColumns({
        "is_cancel_invoice": is_cancel(F.col("invoice_no")),
        "is_negative_qty": F.coalesce(F.col("quantity") < 0, F.lit(False)),
        "is_negative_price": F.coalesce(F.col(price) < 0, F.lit(False)),
        "is_special_stock": is_special_stock(F.col("stock_code")),
    })


def country_group(country: Column, eu: Sequence[str] = fv.EU_COUNTRIES) -> Column:
    return (
        F.when(country == fv.HOME_COUNTRY, "UK")
        .when(country.isin(list(eu)), "EU")
        .otherwise("Other")
    )


def clip(value: Column, lo=None, hi=None) -> Column:
    """Bound a value; NULL stays NULL (``greatest`` and ``least`` alone would skip it)."""
    bounded = value
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        bounded = F.least(bounded, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(value.isNotNull(), bounded)


def safe_ratio(top: Column, bottom: Column, zero: str = "one") -> Column:
    """Ratio that never divides by zero.

    ``one`` raises the denominator to at least 1, ``null_to_zero`` gives 0 for a zero
    denominator, ``tiny`` raises it to at least 1e-9, ``null`` gives NULL.
    """
    if zero == "one":
        return top / clip(bottom, lo=1)
    if zero == "tiny":
        return top / clip(bottom.cast("double"), lo=1e-9)
    ratio = F.try_divide(top.cast("double"), bottom.cast("double"))
    if zero == "null_to_zero":
        return F.coalesce(ratio, F.lit(0.0))
    if zero == "null":
        return ratio
    raise ValueError(f"unknown zero rule: {zero}")


def cut(value: Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge, next edge]`` a value falls in; no interval gives NULL."""
    label = None
    for lo, hi, name in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = value > lo if hi is None else (value > lo) & (value <= hi)
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label


def quantile_bin(value: Column, edges: Sequence[float], strict: bool = False) -> Column:
    """The quantile bin of a value, from all edges, lowest and highest included.

    1 + the number of inner edges below the value: bins are closed on the right, and the lowest
    value is in the first. Equal edges leave some bins empty; ``strict`` raises instead.
    """
    if strict and len(set(edges)) < len(edges):
        raise ValueError(f"quantile edges are not distinct: {list(edges)}")
    score = F.lit(1)
    for edge in edges[1:-1]:
        score = score + F.when(value > edge, 1).otherwise(0)
    return F.when(value.isNotNull(), score.cast("int"))


def rank_bin(rank: Column, n: Column, bins: int = 4) -> Column:
    """Quantile bin of a 1-based rank among ``n``: edges at ``1 + (n - 1) * k / bins``."""
    score = F.lit(1)
    for k in range(1, bins):
        # (rank - 1) * bins > (n - 1) * k keeps the comparison in whole numbers
        score = score + F.when((rank - 1) * bins > (n - 1) * k, 1).otherwise(0)
    return score.cast("int")


def label_at(position: Column, labels: Sequence[str]) -> Column:
    """The position-th label, counting from 1."""
    return F.element_at(F.array(*[F.lit(name) for name in labels]), position)


def map_labels(value: Column, mapping: Mapping, default) -> Column:
    fallback = default if isinstance(default, Column) else F.lit(default)
    if not mapping:
        return fallback
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.create_map(*pairs)[value], fallback)


def rfm_code(r: Column, f: Column, m: Column) -> Column:
    return r * 100 + f * 10 + m


def rfm_segment(r: Column, f: Column, m: Column, recency_days: Column) -> Column:
    """Named segment; recency decides first, then frequency, then spend."""
    recent, often, big = r >= 3, f >= 3, m >= 3
    active = (
        F.when(often & big, "Champions")
        .when(often, "Loyal Customers")
        .when(big, "Potential Loyalists")
        .otherwise("Recent Customers")
    )
    lapsed = (
        F.when(often & big, "High Value")
        .when(often, "Frequent Buyers")
        .when(recency_days > 180, "At Risk")
        .otherwise("Moderate")
    )
    return F.when(recent, active).otherwise(lapsed)


def fill(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """Replace NULL by a constant or by another column's value."""
    filler = value if isinstance(value, Column) else F.lit(value)
    return df.withColumns({c: F.coalesce(F.col(c), filler.cast(df.schema[c].dataType)) for c in columns})


def as_flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def round_columns(df: DataFrame, places: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Round the floating-point columns (or those named) for display."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, places) for c in (columns or floating)})


def split_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """Column names as (numeric, other)."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return numeric, [c for c in df.columns if c not in numeric]
