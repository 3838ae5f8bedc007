"""Exact ranks and exact-size selections that stay distributed under skew.

A plain ``row_number().over(Window.partitionBy(g).orderBy(k))`` sends every
row of a group to one task; when one group holds a third of the table that
task holds a third of the table.  Here the ordering key is a hex digest, so
its first ``prefix_chars`` characters split every group into up to
``16 ** prefix_chars`` near-equal buckets; by default the length is chosen so
the largest group of n rows gets about sqrt(n) buckets of about sqrt(n) rows:
neither the per-group offset window nor the per-bucket row window grows
faster than sqrt(n), and the bucket table stays small enough to broadcast
when no group is large.  Counts per (group, bucket) are a
partial aggregate; cumulative counts over the buckets of a group are a window
over that small table; the exact rank is then ``rows in earlier buckets +
row_number inside the bucket``, and rows meet the count table on the
balanced (group, bucket) key.  The ordering is the same total order as
sorting by the full digest, so results equal the single-window formulation
(and the DuckDB oracle) exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.joins import null_safe_join
from foldwise.session import cut_lineage

DEFAULT_PREFIX_CHARS = None   # chosen from the largest group (see auto_prefix_chars)
THRESHOLD_PREFIX = 5          # a threshold's buckets: at most 16 ** 5 rows a group to add up, no scan to choose a length


HASH_FN = "md5"   # "xxhash64" is several times cheaper but has no DuckDB equal


def hash_key(seed: int | str, *cols: str | Column, fn: str | None = None) -> Column:
    """Deterministic pseudo-random order key as a fixed-width hex string.

    ``md5`` of ``seed|c1|c2...``: DuckDB's ``md5(seed || '|' || c1 || ...)``
    yields the same string, so the oracle can reproduce every selection.
    ``xxhash64``: the 64-bit hash as 16 hex digits (uniform, much cheaper).
    """
    fn = fn or HASH_FN
    if fn == "xxhash64":
        h = F.xxhash64(F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols])
        return F.lpad(F.hex(h), 16, "0")
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def auto_prefix_chars(df: DataFrame, part_cols: Sequence[str]) -> int:
    """Digest-prefix length (1..6 hex digits) balancing the two windows of an
    exact rank for the largest group of n rows: about sqrt(n) buckets (the
    offset window over that group's bucket table) holding about sqrt(n) rows
    each (the row window per bucket).  One small aggregation: the group
    counts, of which only the maximum reaches the driver."""
    import math
    if part_cols:
        biggest = df.groupBy(*part_cols).agg(F.count(F.lit(1)).alias("__c")).agg(F.max("__c")).first()[0] or 0
    else:
        biggest = df.count()
    if biggest <= 16:
        return 1
    return max(1, min(6, math.ceil(math.log(biggest, 16) / 2)))


def bucket_counts(df: DataFrame, part_cols: Sequence[str], key_col: str,
                  prefix_chars: int = DEFAULT_PREFIX_CHARS) -> DataFrame:
    """(part..., __bucket, __n, __before, __group_n) — one row per non-empty bucket."""
    bucketed = df.select(*part_cols, F.substring(F.col(key_col), 1, prefix_chars).alias("__bucket"))
    counts = bucketed.groupBy(*part_cols, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*part_cols).orderBy("__bucket") if part_cols else Window.orderBy("__bucket")
    return counts.withColumns({
        "__before": F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__group_n": F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })


def exact_rank(df: DataFrame, part_cols: Sequence[str], key_col: str, out_col: str = "rank",
               tie_cols: Sequence[str] = (), prefix_chars: int = DEFAULT_PREFIX_CHARS,
               with_group_size: str | None = None) -> DataFrame:
    """Add ``out_col`` = row_number() over (partition by part_cols order by key_col, tie_cols).

    Works for skewed groups: no task ever holds more than one bucket of one
    group.  ``with_group_size`` optionally adds the group's row count.
    """
    if prefix_chars is None:
        prefix_chars = auto_prefix_chars(df, part_cols)
    return exact_sequence(df, part_cols, [F.col(key_col)] + [F.col(c) for c in tie_cols],
                          F.substring(F.col(key_col), 1, prefix_chars), out_col, with_group_size)


def exact_sequence(df: DataFrame, part_cols: Sequence[str], order: Sequence[Column], bucket: Column,
                   out_col: str = "seq", with_group_size: str | None = None) -> DataFrame:
    """Exact row_number() over (partition by part_cols order by ``order``).

    ``bucket`` must be non-decreasing along ``order`` (a digest prefix for a
    digest order, a truncated timestamp for a time order).  Each group is
    split into its buckets; a window over the small (group, bucket) count
    table gives each bucket's offset and a window per (group, bucket) the
    rank inside it.
    """
    part_cols = list(part_cols)
    left = df.withColumn("__bucket", bucket)
    counts = left.groupBy(*part_cols, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    wb = Window.partitionBy(*part_cols).orderBy("__bucket") if part_cols else Window.orderBy("__bucket")
    offs = counts.select(
        *[F.col(c).alias(f"__r_{c}") for c in part_cols + ["__bucket"]],
        F.coalesce(F.sum("__n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        *([F.sum("__n").over(wb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
           .alias(with_group_size)] if with_group_size else []))
    join_cols = part_cols + ["__bucket"]
    cond = None
    for c in join_cols:
        e = left[c].eqNullSafe(offs[f"__r_{c}"])
        cond = e if cond is None else cond & e
    joined = left.join(offs, cond, "inner").drop(*[f"__r_{c}" for c in join_cols])
    w = Window.partitionBy(*join_cols).orderBy(*order)
    return (joined.withColumn(out_col, F.col("__before") + F.row_number().over(w))
                  .drop("__bucket", "__before"))


def global_rank(df: DataFrame, order: Sequence[Column], out_col: str = "rank") -> DataFrame:
    """Add ``out_col`` = row_number() over (order by ``order``) for a whole table.

    Rows are range-partitioned by the order (balanced from a sample, whatever
    the type or prefix of the values), ranges are counted, and rows are
    numbered inside their range.  The only window over one partition holds a
    row per range."""
    from foldwise.operators.cumulative import in_ranges
    ranged = in_ranges(df, order, "__rb")
    counts = ranged.groupBy("__rb").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("__rb", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__rb").orderBy(*order))
    return ranged.join(offs, "__rb").withColumn(out_col, F.col("__before") + number).drop("__rb", "__before")


def key_thresholds(df: DataFrame, part_cols: Sequence[str], key_col: str, k_expr: Column,
                   tie_cols: Sequence[str] = (), prefix_chars: int = THRESHOLD_PREFIX) -> DataFrame:
    """(part..., __last, __quota, __ties): the k-th row of each group in (key, ties)
    order, as a struct, how many rows equal to it are among the first k, and how
    many there are; no row for a group with k = 0.  ``k_expr`` may use ``__group_n``.

    The (group, bucket) counts name the one bucket that holds the k-th row; only
    that bucket's values are counted and added up, so equal rows are one value."""
    part_cols, values = list(part_cols), list(dict.fromkeys([key_col, *tie_cols]))
    narrow = df.select(*dict.fromkeys([*part_cols, *values]))
    buckets = bucket_counts(narrow, part_cols, key_col, prefix_chars).withColumn("__k", F.least(k_expr, F.col("__group_n")))
    cut = buckets.filter((F.col("__before") < F.col("__k")) & (F.col("__k") <= F.col("__before") + F.col("__n"))) \
                 .select(*part_cols, "__bucket", (F.col("__k") - F.col("__before")).alias("__need"))
    edge = null_safe_join(narrow.withColumn("__bucket", F.substring(F.col(key_col), 1, prefix_chars)), cut,
                          part_cols + ["__bucket"])
    counts = edge.groupBy(*part_cols, "__need", *[c for c in values if c not in part_cols]).agg(F.count(F.lit(1)).alias("__ties"))
    before = Window.partitionBy(*part_cols, "__need").orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__ties").over(before), F.lit(0)))
    quota = F.col("__need") - F.col("__before")
    return counts.filter((quota > 0) & (quota <= F.col("__ties"))).select(
        *part_cols, _order_struct(key_col, tie_cols).alias("__last"), quota.alias("__quota"), "__ties")


def _order_struct(key_col: str, tie_cols: Sequence[str]) -> Column:
    return F.struct(F.col(key_col).alias("k"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie_cols)])


def mark_first(df: DataFrame, part_cols: Sequence[str], key_col: str, k_expr: Column, out_col: str,
               tie_cols: Sequence[str] = (), prefix_chars: int = THRESHOLD_PREFIX) -> DataFrame:
    """Add whether a row is among the first k of its group in (key, ties) order:
    a comparison with the group's threshold, so rows are neither shuffled nor
    sorted where the threshold table is small enough to broadcast.

    Exactly k rows are marked.  Where several rows equal the k-th in key and
    ties and only some of them fit, these rows alone are ranked by a hash of
    their place, evenly over the tasks."""
    part_cols = list(part_cols)
    last = cut_lineage(key_thresholds(df, part_cols, key_col, k_expr, tie_cols, prefix_chars))
    marked = null_safe_join(df, last, part_cols, "left") if part_cols else _with_one_row(df, last)
    own = _order_struct(key_col, tie_cols)
    first = F.coalesce(own <= F.col("__last"), F.lit(False))
    columns = [*[F.col(f"`{c}`") for c in df.columns if c != out_col], F.col(f"`{out_col}`")]
    if not last.filter("__ties > __quota").limit(1).count():
        return marked.withColumn(out_col, first).select(*columns)
    some = F.coalesce((own == F.col("__last")) & (F.col("__ties") > F.col("__quota")), F.lit(False))
    tied = cut_lineage(marked.filter(some).withColumn("__place", F.monotonically_increasing_id()))
    tied = exact_rank(tied.withColumn("__place_key", hash_key("ties", "__place")), part_cols, "__place_key", "__nth", ["__place"])
    tied = tied.withColumn(out_col, F.col("__nth") <= F.col("__quota")).select(*columns)
    return marked.filter(~some).withColumn(out_col, first).select(*columns).unionByName(tied)


def _with_one_row(df: DataFrame, last: DataFrame) -> DataFrame:
    """``df`` with the values of a table of at most one row, as literals."""
    row = last.first()
    fields = last.schema.fields
    if row is None:
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields})
    values = [F.struct(*[F.lit(v).cast(x.dataType).alias(x.name) for v, x in zip(row[f.name], f.dataType.fields)])
              if f.name == "__last" else F.lit(row[f.name]) for f in fields]
    return df.withColumns({f.name: v for f, v in zip(fields, values)})


def exact_top_k_per_group(df: DataFrame, part_cols: Sequence[str], key_col: str,
                          k_expr: Column, tie_cols: Sequence[str] = (),
                          prefix_chars: int = THRESHOLD_PREFIX) -> DataFrame:
    """Keep, per group, the first ``k`` rows by ``key_col`` where ``k`` may depend
    on the group size (``k_expr`` may use column ``__group_n``)."""
    return mark_first(df, part_cols, key_col, k_expr, "__first", tie_cols, prefix_chars).filter("__first").drop("__first")
