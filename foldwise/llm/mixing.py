"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a token budget.  Whole copies of a source cover the integer
part of ``target / size``; for the rest, documents below a hash threshold are
taken once more.  The threshold is found without sorting: tokens are summed
by (source, hash bucket), the bucket in which the running sum crosses the
budget is refined by the next bits of the hash, and so on until it holds one
hash value.  All steps are partial aggregates over (source, bucket), so a hot
source is spread like any other, and the last step is a filter.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; rows of equal document id share a hash, so they are taken or
left together; a source of size 0 has target 0; an empty table gives an empty
result.  Extra columns pass through ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import WORD_SEP, join_by_group, let, order_hash, require
from foldwise.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
HASH_BITS = 60
BITS_PER_LEVEL = 12


def word_count(text: Column) -> Column:
    """Number of words: pieces between separators, less an empty head and tail; 0 for null."""
    empty = lambda x: (x == "").cast("int")
    count = let(F.split(text, WORD_SEP), lambda p: F.size(p) - empty(p[0])
                - F.when(F.size(p) > 1, empty(F.element_at(p, -1))).otherwise(0))
    return F.when(text.isNull(), 0).otherwise(count).cast("bigint")


def source_targets(sizes: DataFrame, source_col: str = "source", weights: Sequence[float] = WEIGHTS,
                   max_repeats: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, get the weights in turn and share
    the total by them; a target stops at ``max_repeats`` times its source and
    the excess is shared again.  The fixed point is found in closed form: in
    order of cap / weight, the sources before the break are capped and the
    rest share what is left.  The windows run over one row per source, the
    mix's own specification, not over documents.
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(in_order) - 1
    per = per.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1)))
    per = per.withColumn("__cap", max_repeats * F.col("source_size"))
    by_cap = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    upto, every = by_cap.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    # the share per unit of weight, were this source and all before it (up to the one before it) capped
    per = per.withColumns({
        "__total": F.sum("source_size").over(every),
        "__left": F.sum("__w").over(every) - F.sum("__w").over(upto) + F.col("__w"),
        "__used": F.sum("__cap").over(upto) - F.col("__cap"),
    }).withColumn("__share", (F.col("__total") - F.col("__used")) / F.col("__left"))
    per = per.withColumn("__open", F.col("__cap") > F.col("__share") * F.col("__w"))
    level = F.first(F.when(F.col("__open"), F.col("__share")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("__cap"), F.coalesce(level * F.col("__w"), F.col("__cap")))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): rows (source, size, h) with ``h < threshold`` sum up to
    the source's ``budget`` as nearly as whole hash values allow."""
    # `low`: where the open interval of hashes begins; `budget`: what is left of it there
    state = cut_lineage(budgets.select("source", "budget", F.lit(0).cast("bigint").alias("low")))
    shift = HASH_BITS
    while shift > 0:
        above, shift = shift, max(0, shift - BITS_PER_LEVEL)
        at = state.select("source", "budget", "low")
        inside = join_by_group(sizes, at, ["source"], F.col("h")).where(
            F.shiftright(F.col("h"), above) == F.shiftright(F.col("low"), above)).select(
            "source", F.shiftright(F.col("h"), shift).alias("bucket"), "size", "h")
        sums = inside.groupBy("source", "bucket").agg(
            F.sum("size").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("before", run - F.col("n"))
        edge = sums.join(at, _same_source(sums, at)).where(
            (F.col("before") < F.col("budget")) & (F.col("budget") <= F.col("before") + F.col("n"))).select(
            sums["source"], (F.col("budget") - F.col("before")).alias("budget"), "n", "h0", "h1")
        state = cut_lineage(edge.select("source", "budget", "n", F.col("h0").alias("low"), "h1"))
        # one number: whether some boundary bucket still holds more than one hash
        if not state.where("low < h1").limit(1).count():
            break
    # the last hash goes in if that leaves the sum nearer to the budget
    return state.select("source", (F.col("low") + F.when(2 * F.col("budget") >= F.col("n"), 1).otherwise(0))
                        .alias("threshold"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, max_repeats: int = 3, size_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target, copies (how
    often the mix takes the document) and taken (words it takes).

    Sizes are word counts of ``text_col``, or the long column ``size_col``."""
    require(docs, id_col, size_col or text_col, source_col)
    size = F.col(f"`{size_col}`") if size_col else word_count(F.col(f"`{text_col}`"))
    new = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c not in new]
    sized = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(keep)],
                        F.col(f"`{source_col}`").alias("source"), size.alias("size"),
                        order_hash(F.col(f"`{id_col}`")).alias("h"))
    sizes = cut_lineage(sized.select("source", "size", "h"))
    plan = source_targets(sizes, "source", weights, max_repeats)
    whole = F.when(F.col("source_size") > 0,
                   F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0)
    plan = cut_lineage(plan.withColumn("whole", whole.cast("bigint")))
    budgets = plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")) \
        .where("budget > 0")
    cuts = thresholds(sizes, budgets)
    plan = plan.join(cuts, _same_source(plan, cuts), "left").select(
        plan["source"], "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    copies = F.least(F.col("whole") + (F.col("h") < F.col("threshold")).cast("bigint"), F.lit(max_repeats))
    return join_by_group(sized, cut_lineage(plan), ["source"], F.col("h")).select(
        *[F.col(f"c_{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every document as often as it is taken (at most
    ``max_repeats`` times), with the columns of ``docs``."""
    mixed = mix(docs, **kw)
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))) \
                .select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'),
        lambda x: x <> '')), 0)::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM d GROUP BY source),
c AS (SELECT *, 3.0 * source_size AS cap, sum(source_size) OVER () AS total,
        sum(w) OVER () - sum(w) OVER o + w AS rest, sum(3.0 * source_size) OVER o - 3.0 * source_size AS used FROM s
      WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT min_by(share, cap / w) AS share FROM (SELECT (total - used) / rest AS share, cap, w FROM c)
       WHERE cap > share * w),
t AS (SELECT source, source_size, least(cap, coalesce(share * w, cap))::DOUBLE AS target FROM c, lv),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS before FROM g),
e AS (SELECT r.source, h + CASE WHEN 2 * (target - whole * source_size - before) >= n THEN 1 ELSE 0 END AS threshold
      FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
      WHERE before < target - whole * source_size AND target - whole * source_size <= before + n)
SELECT doc_id, size, b.source_size, target,
       (size * least(whole + CASE WHEN h < coalesce(threshold, 0) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source"""
