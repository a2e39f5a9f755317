"""Reproducible sampling and splitting (M-1..M-6, P-2).

Every decision is a function of ``md5(key || ':' || seed)`` (hex), so it does
not depend on row order or partitioning and DuckDB can restate it.

``exact_pick`` (P-2) selects exactly ``target`` rows per group, the ones with
the smallest hashes, without sorting the data.  The input is evaluated twice.
The first time only each row's group, 16-byte hash and tie columns are staged;
counts per two-byte hash bucket (at most 65,536 rows per group, partial
aggregation) locate the bucket that holds the cut.  The rows of the cut buckets
alone (about rows / 65,536 for keys that do not repeat) are range partitioned
by (hash, tie), counted per partition, and the partition that holds the cut is
ranked: a key that holds a third of all rows is spread over the partitions by
its ties, so no task ranks a whole key or group.  The second time every row is
flagged by comparing its (hash, tie) with that of the last selected row.
Several targets (nested fractions) share one pass.

Without ``tie`` columns all columns and a staged row number break ties, so a
selection is exact for repeated keys and repeated rows too.  Null group keys
form a group of their own.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

MAX_BROADCAST_GROUPS = 100_000


def _col(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def hash_hex(key, seed) -> Column:
    key = _col(key)
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def fraction_target(fraction) -> callable:
    """floor(fraction * n) in exact decimal arithmetic."""
    f = F.lit(Decimal(str(fraction)))
    return lambda n: F.floor(n * f).cast("long")


def quota_target(quota: int) -> callable:
    return lambda n: F.least(n, F.lit(quota)).cast("long")


def _cut(buckets: DataFrame, part: list[str], bcol: str, target_col: str) -> DataFrame:
    """Given (part, bcol, cnt, target) rows, the bucket where the cut falls and
    how many of its rows are still needed: (part, <bcol>_cut, <bcol>_need)."""
    w = Window.partitionBy(*part).orderBy(bcol).rowsBetween(Window.unboundedPreceding, 0)
    c = buckets.withColumn("_cum", F.sum("cnt").over(w))
    return (c.where((F.col("_cum") >= F.col(target_col)) & (F.col("_cum") - F.col("cnt") < F.col(target_col)))
             .select(*part, F.col(bcol).alias(f"{bcol}_cut"),
                     (F.col(target_col) - (F.col("_cum") - F.col("cnt"))).alias(f"{bcol}_need")))


def kth_keys(keys: DataFrame, by: list[str], tie: tuple[str, ...], targets: dict,
             bound: int | None) -> tuple[DataFrame, int | None]:
    """Per group and target name: the ``(__h, tie…)`` of the ``target(n)``-th row in hash
    order (no row when the target is 0), and the group bound used for broadcasts.
    ``keys`` is a staged table of the ``by`` columns, ``__b`` (bucket), ``__h`` and ``tie``."""
    names = list(targets)
    buckets = materialize(keys.groupBy(*by, "__b").agg(F.count("*").alias("cnt")), "split-buckets")
    if bound is None:
        # broadcasts below happen only behind the counted number of groups
        n_groups = buckets.select(*by).distinct().count()
        bound = n_groups if n_groups <= MAX_BROADCAST_GROUPS else None
    nb = None if bound is None else bound * len(names)
    tot = buckets.groupBy(*by).agg(F.sum("cnt").alias("__n"))
    tg = tot.select(*by, F.explode(F.array(*[
        F.struct(F.lit(nm).alias("tname"), targets[nm](F.col("__n")).alias("__t")) for nm in names
    ])).alias("_x")).select(*by, "_x.tname", "_x.__t")
    cut = _cut(buckets.join(broadcast_if_small(tg, nb), by), [*by, "tname"], "__b", "__t")
    # joined on the bucket too, so beyond the bound a hot group is dealt out by bucket
    rows = keys.join(broadcast_if_small(cut.withColumnRenamed("__b_cut", "__b"), nb), [*by, "__b"])
    order = [*by, "tname", "__h", *tie]
    ranged = materialize(rows.select(*order, "__b_need").repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__p", F.spark_partition_id()), "split-cut")
    sizes = ranged.groupBy(*by, "tname", "__p", F.col("__b_need").alias("__t")).agg(F.count("*").alias("cnt"))
    last = _cut(sizes, [*by, "tname"], "__p", "__t").withColumnRenamed("__p_cut", "__p")
    # the rows of one range partition at most for a group and target
    w = Window.partitionBy(*by, "tname").orderBy("__h", *tie)
    kth = (ranged.join(broadcast_if_small(last, nb), [*by, "tname", "__p"])
           .withColumn("__r", F.row_number().over(w)).where(F.col("__r") == F.col("__p_need"))
           .select(*by, "tname", F.struct("__h", *tie).alias("__kth")))
    return kth, bound


def exact_pick_many(df: DataFrame, key, seed, targets: dict, by: tuple[str, ...] = (),
                    tie: tuple[str, ...] = (), max_groups: int | None = None) -> DataFrame:
    """Add one boolean column per ``targets`` entry (name -> target(n)): the
    ``target(n_group)`` rows per group with the smallest ``(md5(key:seed),
    tie…)``.  Exact, order-independent, nested across targets.

    ``max_groups``: a known bound on the number of groups.  Without it the
    groups are counted from the staged bucket histogram; the per-group cut
    tables are broadcast when that count is at most ``MAX_BROADCAST_GROUPS``
    and joined by shuffle beyond it."""
    bound = 1 if not by else max_groups
    d = df
    if not tie:
        d = materialize(d.withColumn("__row", F.monotonically_increasing_id()), "split-rows")
        tie = (*[n for n, t in df.dtypes if "map<" not in t and t != "variant"], "__row")
    # group keys as text, so that a null is a key like any other
    groups = {f"__g{i}": F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string")))
              for i, c in enumerate(by)} or {"__g0": F.lit("all")}
    d, by = d.withColumns(groups), list(groups)
    d = d.withColumn("__h", F.unhex(hash_hex(F.coalesce(_col(key).cast("string"), F.lit("")), seed)))
    bucket = F.conv(F.hex(F.substring("__h", 1, 2)), 16, 10).cast("int")
    keys = materialize(d.select(*by, bucket.alias("__b"), "__h", *tie), "split-keys")
    kth, bound = kth_keys(keys, by, tie, targets, bound)
    wide = kth.groupBy(*by).pivot("tname", list(targets)).agg(F.first("__kth"))
    # one row per group: broadcast when the group count is bounded, so the
    # data is never shuffled by the (possibly skewed) group key
    d = d.join(broadcast_if_small(wide, bound), by, "left")
    me = F.struct("__h", *tie)
    for nm in targets:
        d = d.withColumn(f"__flag_{nm}", F.coalesce(me <= F.col(nm), F.lit(False)))
    for nm in targets:
        d = d.drop(nm).withColumnRenamed(f"__flag_{nm}", nm)
    return d.drop(*by, "__h", "__row")


def exact_pick(df: DataFrame, key, seed, target, by: tuple[str, ...] = (),
               tie: tuple[str, ...] = (), out: str = "picked",
               max_groups: int | None = None) -> DataFrame:
    """One exact selection (see ``exact_pick_many``) as boolean ``out``."""
    return exact_pick_many(df, key, seed, {out: target}, by, tie, max_groups)


def exact_fraction(df: DataFrame, key, fraction, seed=42, by=(), tie=(), out="picked",
                   max_groups=None) -> DataFrame:
    """M-2/M-3: exactly floor(fraction * n) rows per group flagged ``out``."""
    return exact_pick(df, key, seed, fraction_target(fraction), by, tie, out, max_groups)


def exact_quota(df: DataFrame, key, quota: int, seed=42, by=(), tie=(), out="picked",
                max_groups=None) -> DataFrame:
    """M-6/O-6: exactly min(quota, n) rows per group."""
    return exact_pick(df, key, seed, quota_target(quota), by, tie, out, max_groups)


def approx_threshold(fraction) -> str:
    """Eight hex digits that about ``fraction`` of all hashes sort below ('g': all)."""
    cut = int(Decimal(str(fraction)) * 2**32)
    return "g" if cut >= 2**32 else format(max(cut, 0), "08x")


def approx_fraction(df: DataFrame, key, fraction, seed=42, out="picked") -> DataFrame:
    """M-4: ``substr(md5(key:seed), 1, 8) < threshold``: one narrow filter,
    about ``fraction`` of the rows, same rows in every engine."""
    return df.withColumn(out, F.substring(hash_hex(key, seed), 1, 8) < F.lit(approx_threshold(fraction)))


def nested_levels(df: DataFrame, key, fractions, seed=42, by=(), tie=(),
                  out="min_fraction", max_groups=None) -> DataFrame:
    """M-5: nested exact subsets (prefixes of one hash order), all cut in one
    pass; ``out`` is the smallest fraction whose subset holds the row (null:
    in none)."""
    fractions = sorted(fractions)
    targets = {f"__in{i}": fraction_target(f) for i, f in enumerate(fractions)}
    d = exact_pick_many(df, key, seed, targets, by, tie, max_groups)
    level = None
    for name, f in zip(reversed(list(targets)), reversed(fractions)):
        level = F.when(F.col(name), F.lit(float(f))) if level is None else \
            F.when(F.col(name), F.lit(float(f))).otherwise(level)
    return d.withColumn(out, level).drop(*targets)


def hash_order(df: DataFrame, key, seed=42, by: tuple[str, ...] = ()) -> DataFrame:
    """M-1: a full reproducible shuffle: global order by the row hash, inside each
    ``by`` group if given (a range partitioned sort; no single-partition step)."""
    return df.orderBy(*by, hash_hex(key, seed), *[c for c in df.columns if c not in by])


def hash_sample_rows(df: DataFrame, key, n: int, seed=42) -> DataFrame:
    """M-9/O-7: the ``n`` rows with the smallest hashes (a top-k); equal keys
    are ordered by all columns."""
    return df.orderBy(hash_hex(key, seed), *[c for c, t in df.dtypes if "map<" not in t]).limit(n)
