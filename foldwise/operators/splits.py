"""Group-aware and stratified splits as columns on one table.

Folds are never materialised as separate copies: a fold column (or a small
group -> fold table joined back) lets each training step filter the same
persisted table, and partition pruning applies when it is stored partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.joins import null_safe_join
from foldwise.operators.ranking import exact_rank, exact_sequence, global_rank, hash_key, mark_first


def group_sizes(df: DataFrame, group_col: str) -> DataFrame:
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))


def logo_folds(df: DataFrame, group_col: str) -> DataFrame:
    """Leave-one-group-out: (group, fold, n_test, n_train); fold = index of the
    group in sorted order (exact rank over the range-partitioned per-group table)."""
    sizes = group_sizes(df, group_col)
    total = sizes.agg(F.sum("n")).scalar()
    ranked = global_rank(sizes, [F.col(group_col).asc()], "__seq")
    return ranked.select(
        group_col,
        (F.col("__seq") - 1).cast("int").alias("fold"),
        F.col("n").alias("n_test"),
        (total - F.col("n")).cast("bigint").alias("n_train"))


def snake_group_kfold(df: DataFrame, group_col: str, n_splits: int) -> DataFrame:
    """Distributed balanced group folds: groups by size desc (ties by id) dealt
    0,1,..,k-1,k-1,..,0,...  Returns (group, fold, n)."""
    _check_splits(df, group_col, n_splits)
    sizes = group_sizes(df, group_col)
    k = F.lit(n_splits)
    ranked = global_rank(sizes, [F.col("n").desc(), F.col(group_col).asc()], "__seq") \
        .withColumn("__r", F.col("__seq") - 1)
    pos, block = F.col("__r") % k, F.floor(F.col("__r") / k)
    return ranked.select(group_col, F.when(block % 2 == 0, pos).otherwise(k - 1 - pos).cast("int").alias("fold"),
                         "n")


def greedy_phases(sizes: list[tuple[int, int]], n_splits: int) -> list[tuple[int, int, int, list[int]]]:
    """The greedy assignment of groups in size order as phases (n, first, last, folds):
    the groups of size n with ranks first..last go to ``folds`` in turn.

    ``sizes`` has (n, number of groups of that size), largest first.  Groups of
    one size go round the folds that are lighter than the lightest plus n; a
    further fold joins when the others have come up to it, so a size has at most
    ``n_splits`` phases however many groups it has.
    """
    load, out, rank = [0] * n_splits, [], 0
    for n, m in sizes:
        while m > 0:
            lightest = min((x, i) for i, x in enumerate(load))
            turn = sorted((x, i) for i, x in enumerate(load) if (x, i) < (lightest[0] + n, lightest[1]))
            turn += [lightest] if lightest not in turn else []
            folds = [i for _, i in sorted(turn)]
            # full rounds until the next fold is lighter than a second turn of the lightest
            rest = [(x, i) for i, x in enumerate(load) if i not in folds]
            rounds = min((max(1, (x - lightest[0]) // n + (i > lightest[1]) - 1) for x, i in rest), default=m)
            taken = min(m, rounds * len(folds))
            out.append((n, rank, rank + taken - 1, folds))
            for k, i in enumerate(folds):
                load[i] += n * (taken // len(folds) + (k < taken % len(folds)))
            rank, m = rank + taken, m - taken
    return out


def greedy_group_kfold(df: DataFrame, group_col: str, n_splits: int) -> DataFrame:
    """GroupKFold: largest group first, each to the currently lightest fold
    (ties to the lower fold and, among groups of one size, by id).

    Groups are ranked in Spark.  Only the histogram of group sizes reaches the
    driver (N rows have at most sqrt(2 N) distinct sizes); it is turned into
    phases in which groups go round a list of folds, and each group looks its
    phase up by size and rank."""
    _check_splits(df, group_col, n_splits)
    sizes = group_sizes(df, group_col)
    ranked = global_rank(sizes, [F.col("n").desc(), F.col(group_col).asc()], "__seq")
    histogram = [(r[0], r[1]) for r in sizes.groupBy("n").agg(F.count(F.lit(1))).orderBy(F.col("n").desc()).collect()]
    phases = df.sparkSession.createDataFrame(greedy_phases(histogram, n_splits),
                                             "__n bigint, __first bigint, __last bigint, __folds array<int>")
    r = F.col("__seq") - 1
    hit = (F.col("n") == F.col("__n")) & (r >= F.col("__first")) & (r <= F.col("__last"))
    fold = F.get("__folds", ((r - F.col("__first")) % F.size("__folds")).cast("int"))
    return ranked.join(phases, hit).select(group_col, fold.alias("fold"), "n")


def _check_splits(df: DataFrame, group_col: str, n_splits: int) -> int:
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    n_groups = df.select(group_col).distinct().count()
    if n_splits > n_groups:
        raise ValueError(f"cannot have n_splits={n_splits} greater than the number of groups={n_groups}")
    return n_groups


def assign_folds(df: DataFrame, fold_map: DataFrame, group_col: str) -> DataFrame:
    """Row -> fold by group (JN-4).  The map has one row per group: it is
    broadcast when its counted size is small, so a hot group never meets a
    shuffle on the group key."""
    from foldwise.operators.joins import join_lookup
    return join_lookup(df, fold_map.select(group_col, "fold"), group_col, "inner")


def fold_frames(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, validation) views of one fold (FLT-2)."""
    return df.filter(F.col(fold_col) != fold), df.filter(F.col(fold_col) == fold)


def holdout_group(df: DataFrame, group_col: str, group) -> tuple[DataFrame, DataFrame]:
    """Hold out one group: (rest, group) (FLT-2)."""
    return df.filter(F.col(group_col) != group), df.filter(F.col(group_col) == group)


def stratified_folds(df: DataFrame, label_col: str, id_col: str, n_splits: int = 5,
                     seed: int = 42, out_col: str = "fold") -> DataFrame:
    """Shuffled stratified k-fold: within each class, rows in md5(seed|id)
    order are dealt to folds 0..k-1 in turn (exact rank, skew-safe)."""
    keyed = df.withColumn("__key", hash_key(seed, id_col))
    ranked = exact_rank(keyed, [label_col], "__key", "__rank", tie_cols=[id_col])
    return ranked.withColumn(out_col, ((F.col("__rank") - 1) % n_splits).cast("int")).drop("__key", "__rank")


def stratified_holdout(df: DataFrame, label_col: str, id_col: str, fraction: float = 0.1,
                       seed: int = 42, out_col: str = "is_val") -> DataFrame:
    """Per class, the first round(fraction * n_class) rows by key are validation."""
    keyed = df.withColumn("__key", hash_key(seed, id_col))
    k = F.round(F.lit(float(fraction)) * F.col("__group_n")).cast("bigint")
    return mark_first(keyed, [label_col], "__key", k, out_col, [id_col]).drop("__key")


def random_holdout(df: DataFrame, id_col: str, fraction: float = 0.33, seed: int = 42,
                   out_col: str = "is_test") -> DataFrame:
    """Exact-size random hold-out: ceil(fraction * n) rows first by key."""
    keyed = df.withColumn("__key", hash_key(seed, id_col))
    k = F.ceil(F.lit(float(fraction)) * F.col("__group_n")).cast("bigint")
    return mark_first(keyed, [], "__key", k, out_col, [id_col]).drop("__key")


def rank_for_holdouts(df: DataFrame, label_col: str, id_col: str, seed: int = 42, out_col: str = "__rank") -> DataFrame:
    """Add each row's rank in its class by md5(seed|id), unique even where ids repeat."""
    keyed = df.withColumn("__key", hash_key(seed, id_col))
    return exact_rank(keyed, [label_col], "__key", out_col, tie_cols=[id_col]).drop("__key")


def group_holdout_cuts(ranked: DataFrame, label_col: str, group_col: str, fraction: float = 0.1,
                       rank_col: str = "__rank") -> DataFrame:
    """(group, label, n_test, n_rest, n_val, cut) for leaving each group out: of the class's other rows, those of rank
    up to ``cut`` are the stratified hold-out, ``n_val`` = round(fraction * n_rest) of them.

    The hold-outs of all groups come from one pass: the k-th row that is not the group's has rank k plus the number of
    the group's rows before it.  A class the group lacks has no row here; its cut is round(fraction * n_class)."""
    own = ranked.select(group_col, label_col, rank_col)
    sizes = own.groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("n_test"))
    of_label = sizes.groupBy(label_col).agg(F.sum("n_test").alias("n_class"))
    sizes = null_safe_join(sizes, of_label, label_col)
    rest = F.col("n_class") - F.col("n_test")
    sizes = sizes.select(group_col, label_col, "n_test", rest.alias("n_rest"),
                         F.round(F.lit(float(fraction)) * rest).cast("bigint").alias("n_val"))
    nth = exact_sequence(own, [group_col, label_col], [F.col(rank_col)], F.floor(F.col(rank_col) / 4096), "__nth")
    placed = null_safe_join(nth, sizes, [group_col, label_col])
    shift = F.sum((F.col(rank_col) - F.col("__nth") < F.col("n_val")).cast("bigint"))
    cuts = placed.groupBy(group_col, label_col, "n_test", "n_rest", "n_val").agg(shift.alias("__shift"))
    return cuts.select(group_col, label_col, "n_test", "n_rest", "n_val", (F.col("n_val") + F.col("__shift")).alias("cut"))
