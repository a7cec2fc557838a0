"""References to records that do not exist.

``orphans`` checks references of any number of columns against a target table.
Composite keys may be partly null; the declared match semantics say what then
holds (SQL's MATCH clause):

* ``simple``:  a reference with any null column is no reference;
* ``partial``: the non-null columns must be found together in some target row;
* ``full``:    all columns null is no reference, some null is always an orphan.

References are grouped by their null mask; each mask is one anti-join on its
non-null columns, so every join is an equi-join and no OR or null-safe test
reaches the optimizer. Targets are reduced to distinct keys per mask before the
shuffle. Hot keys of the referring side (more than 1/64 of all references, so
never more than 64 keys, which a partial count finds) are spread: their target
rows are copied ``salts`` times and each reference takes one copy by a hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

MATCHES = ("simple", "partial", "full")


def clean_key(column: Column | str) -> Column:
    """A key without outer white space and letter case; blank becomes null."""
    c = F.col(column) if isinstance(column, str) else column
    trimmed = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
    return F.when(trimmed != "", trimmed)


def mask(columns: Sequence[str]) -> Column:
    """Bit i is set where column i is not null."""
    bits = [F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)]
    return reduce(lambda a, b: a + b, bits)


HOT_SHARE = 64


def hot_keys(df: DataFrame, hashed: Column) -> list[int]:
    """Hashes of the keys that hold more than 1/HOT_SHARE of the rows: by that definition at most HOT_SHARE."""
    counts = df.groupBy(hashed.alias("h")).agg(F.count("*").alias("n"))
    total = df.count()
    return [r.h for r in counts.filter(F.col("n") * HOT_SHARE > F.lit(max(total, 100_000))).collect()]


def orphans(
    references: DataFrame,
    targets: DataFrame,
    columns: Sequence[str],
    target_columns: Sequence[str] | None = None,
    match: str = "simple",
    at: str | None = None,
    valid_from: str | None = None,
    valid_to: str | None = None,
    salts: int = 16,
) -> DataFrame:
    """The rows of ``references`` whose key has no target; all their columns stay as they are.

    With ``at`` (a time of the reference) a target counts only if
    ``valid_from <= at < valid_to`` of one of its rows; a null bound is open,
    but a row whose ``valid_from`` column is null still exists. A null ``at``
    only asks for existence. Repeated references stay repeated, repeated targets
    count once. Empty tables are allowed: without targets every reference is an
    orphan. Column names of both sides may clash; the target's never show up.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    target_columns = list(target_columns or columns)
    n = len(columns)
    full = (1 << n) - 1
    masks = [full] if match != "partial" else [sum(b << i for i, b in enumerate(bits)) for bits in product((0, 1), repeat=n)]
    masks = [m for m in masks if m]
    mark = "__mask"
    while mark in references.columns:
        mark += "_"
    marked = references.withColumn(mark, mask(columns))
    plain = [F.col(f"`{c}`").cast("string") for c, t in references.dtypes if not t.startswith(("map", "struct", "array"))]
    spread = F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
    parts = []
    for m in masks:
        used = [i for i in range(n) if m >> i & 1]
        names = [f"__k{i}" for i in used]
        left = marked.filter(F.col(mark) == m)
        hot = hot_keys(left, F.xxhash64(*[F.col(columns[i]) for i in used])) if salts > 1 else []

        def is_hot(cols: list[Column]) -> Column:
            return F.xxhash64(*cols).isin(hot) if hot else F.lit(False)

        left = left.withColumn("__salt", F.when(is_hot([F.col(columns[i]) for i in used]), spread).otherwise(F.lit(0)))
        low = F.col(valid_from) if valid_from else F.lit(None).cast("timestamp")
        high = F.col(valid_to) if valid_to else F.lit(None).cast("timestamp")
        spans = targets.select(*[F.col(target_columns[i]).alias(f"__k{i}") for i in used], low.alias("__low"), high.alias("__high"))
        spans = spans.dropna(subset=names)
        spans = spans.distinct() if at else spans.select(*names).distinct()
        copies = F.when(is_hot([F.col(k) for k in names]), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        spans = spans.withColumn("__s", F.explode(copies))
        on = [left[columns[i]] == spans[f"__k{i}"] for i in used] + [left["__salt"] == spans["__s"]]
        if at:
            t = left[at]
            on.append(F.coalesce(spans["__low"] <= t, F.lit(True)) & F.coalesce(t < spans["__high"], F.lit(True)))
        parts.append(left.join(spans, reduce(lambda a, b: a & b, on), "left_anti").drop("__salt"))
    if match == "full":
        parts.append(marked.filter((F.col(mark) != 0) & (F.col(mark) != full)))
    return reduce(DataFrame.unionByName, parts).drop(mark)


def orphan_report(found: DataFrame, group: Sequence[str], period: str) -> DataFrame:
    """Orphans per table, field and period."""
    return found.groupBy(*group, period).agg(F.count("*").alias("n_orphans"), F.countDistinct("record_id").alias("n_records"))


def current_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the latest ``order`` (null counts as earliest), without a sort: a partial aggregate."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))))
    return df.groupBy(key).agg(best.alias("__r")).select(key, *[F.col("__r")[c].alias(c) for c in rest])
