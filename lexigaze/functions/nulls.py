"""Null-faithful building blocks.

Missing values are SQL NULL throughout. NaN counts as missing, too, and is turned
into NULL at the edge (``nan_to_null``). The helpers keep the semantics analysts of
such tables rely on: a missing value is a value of its own for ``n_distinct`` and for
join keys, an aggregate without "remove missing" is missing as soon as one input is,
and a test on a missing value selects neither branch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


# ---------------------------------------------------------------- aggregates

def n_distinct(c: Column | str) -> Column:
    """Distinct values of ``c``, NULL counted as one more value."""
    c = col_of(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))


def strict(agg: Callable[[Column], Column], c: Column | str) -> Column:
    """``agg(c)``, but NULL when the group holds any NULL in ``c``."""
    c = col_of(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def n_rows() -> Column:
    return F.count(F.lit(1))


def count_where(test: Column) -> Column:
    return F.count_if(test)


def n_missing(c: Column | str) -> Column:
    return F.count_if(col_of(c).isNull())


# ------------------------------------------------------------------- scalars

def if_else(test: Column, yes, no) -> Column:
    """Three-valued choice: a NULL test gives NULL, not ``no``."""
    return F.when(test, yes).when(~test, no)


def is_one_of(c: Column | str, values: Iterable) -> Column:
    """Membership in a literal list; never NULL (a missing value is not a member)."""
    return F.coalesce(col_of(c).isin(list(values)), F.lit(False))


def to_number(c: Column | str, type_name: str = "double") -> Column:
    return col_of(c).try_cast(type_name)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL for a zero or missing denominator."""
    return F.try_divide(col_of(a).cast("double"), col_of(b).cast("double"))


def recode(c: Column | str, mapping: Mapping[str, str | None]) -> Column:
    """Replace listed values; others pass through. A value mapped to None becomes NULL."""
    c = col_of(c)
    renamed = {k: v for k, v in mapping.items() if v is not None}
    dropped = [k for k, v in mapping.items() if v is None]
    out = c
    if renamed:
        pairs = [F.lit(x) for kv in renamed.items() for x in kv]
        out = F.coalesce(F.create_map(*pairs)[c], c)
    if dropped:
        out = F.when(~c.isin(dropped), out)
    return out


def lookup(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Label mapping; values outside the mapping become NULL."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[col_of(c)]


def separate(df: DataFrame, c: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """Split ``c`` into columns; surplus pieces are dropped, missing ones are NULL."""
    pieces = F.split(F.col(c), "\\Q" + sep + "\\E")
    return df.withColumns({name: F.get(pieces, F.lit(i)) for i, name in enumerate(into)})


# ---------------------------------------------------------------- whole rows

def fill_zero(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """NULL and NaN become 0 in the listed numeric columns."""
    return df.fillna(0, subset=list(cols))


def natural_keys(left: DataFrame, right: DataFrame, expect: Sequence[str] | None = None) -> list[str]:
    shared = [c for c in left.columns if c in set(right.columns)]
    if expect is not None and set(shared) != set(expect):
        raise ValueError(f"natural join on {shared}, expected {sorted(expect)}")
    if not shared:
        raise ValueError("the two tables share no column")
    return shared


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "left", expect: Sequence[str] | None = None
) -> DataFrame:
    """Equi-join on every shared column name where a missing key matches a missing key.

    The join strategy is left to the optimizer and adaptive execution, which broadcast a
    side only after its size is known and split skewed shuffle partitions.
    """
    keys = natural_keys(left, right, expect)
    # right columns get names of their own, so tables with a common origin can be joined
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    joined = left.join(r, on, how)
    kept = {c: F.col(f"_r_{c}") if how == "right" else F.col(c) for c in keys}
    return joined.select(
        *[kept[c].alias(c) if c in kept else F.col(c) for c in left.columns],
        *[F.col(f"_r_{c}").alias(c) for c in right.columns if c not in kept],
    )


def attach(df: DataFrame, stats: DataFrame, group: Sequence[str], how: str = "left", salts: int = 1) -> DataFrame:
    """Join per-group numbers back to the rows.

    Without a group ``stats`` is the single row of a global aggregate, so it is sent to
    every task. With ``salts`` the rows of a group are dealt to that many tasks and the
    group's numbers repeated for each: for few groups that hold many rows.
    """
    if group and salts > 1:
        salted = natural_join(df.withColumn("_salt", F.spark_partition_id() % salts),
                              stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))),
                              how, expect=[*group, "_salt"])
        return salted.drop("_salt")
    if group:
        return natural_join(df, stats, how, expect=list(group))
    key = F.lit(1).alias("_all")
    one_row = F.broadcast(stats.select("*", key))
    return df.select("*", key).join(one_row, "_all", how).drop("_all")


def _members(other: DataFrame, on: Mapping[str, str]) -> DataFrame:
    return other.select(*[F.col(o).alias(f"_m_{c}") for c, o in on.items()]).distinct()


def _as_mapping(on: str | Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    if isinstance(on, Mapping):
        return dict(on)
    names = [on] if isinstance(on, str) else list(on)
    return {c: c for c in names}


def _semi(df: DataFrame, other: DataFrame, on, how: str) -> DataFrame:
    on = _as_mapping(on)
    test = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in on]
    return df.join(_members(other, on), reduce(lambda a, b: a & b, test), how)


def in_table(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows whose key occurs in ``other`` (missing matches missing)."""
    return _semi(df, other, on, "left_semi")


def not_in_table(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows whose key does not occur in ``other`` (missing matches missing)."""
    return _semi(df, other, on, "left_anti")


def spread(
    df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], value: str | Column,
    agg: Callable[[Column], Column] = F.first,
) -> DataFrame:
    """Long to wide with a fixed list of new columns; a missing cell is NULL, two rows in one cell are an error."""
    value = col_of(value)
    if agg is F.first:
        one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"several rows in one cell of {name}"))).otherwise(F.first(value))
        return df.groupBy(*keys).pivot(name, list(values)).agg(one)
    return df.groupBy(*keys).pivot(name, list(values)).agg(agg(value))


def spread_counts(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str]) -> DataFrame:
    """Count per category, one column per listed category.

    Only groups with at least one listed category appear, and a category a group never
    uses is NULL there, as in count-then-widen.
    """
    picked = df.filter(is_one_of(name, values))
    counts = {v: F.count_if(F.col(name) == v) for v in values}
    return picked.groupBy(*keys).agg(*[F.nullif(c, F.lit(0)).alias(v) for v, c in counts.items()])
