"""Per-group feature files (CSV), processed tables (Parquet) and models.

CSV traps handled here:
* Spark binds a user schema and even a header **by position**; files with
  different headers read together would silently shift columns.  Each line
  is therefore bound to its own file's header by name (see
  :func:`read_group_csvs`), then cast by name.
* ``cast('3.0' as int)`` raises under ANSI mode: integers go through double.
* A non-numeric cell raises (ANSI cast), as the reference's strict cast does.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from foldwise.schema import GROUP_COLUMN, feature_types

FEATURE_FILE_SUFFIX = ".ann.features.csv"
GROUP_FROM_PATH = r"/([^/]+)/[^/]+$"   # parent directory name


def list_group_files(spark: SparkSession, data_dir: str, suffix: str = FEATURE_FILE_SUFFIX) -> DataFrame:
    """(group, path) for every ``<dir>/<group>/<file><suffix>``; sorted.

    Uses the binaryFile source for listing only (the content column is
    pruned, so no file body is read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", f"*{suffix}").load(data_dir).select("path"))
    return files.select(F.regexp_extract("path", GROUP_FROM_PATH, 1).alias(GROUP_COLUMN), "path") \
                .orderBy(GROUP_COLUMN, "path")


def available_groups(spark: SparkSession, data_dir: str, suffix: str = FEATURE_FILE_SUFFIX) -> list[str]:
    """Sorted group ids having a feature file (a metadata listing)."""
    return [r[0] for r in list_group_files(spark, data_dir, suffix).select(GROUP_COLUMN).distinct()
            .orderBy(GROUP_COLUMN).collect()]


def group_path(data_dir: str, group: str, suffix: str = FEATURE_FILE_SUFFIX) -> str:
    return f"{data_dir.rstrip('/')}/{group}/{group}{suffix}"


def cast_by_name(df: DataFrame, types: dict[str, DataType]) -> DataFrame:
    """Cast every known column by name; integers via double ("3.0" -> 3).
    Unknown columns are kept as they are."""
    cols = []
    for name in df.columns:
        t = types.get(name)
        c = F.col(f"`{name}`")
        if t is None:
            cols.append(c)
        elif isinstance(t, (IntegerType, LongType, ShortType)):
            cols.append(c.cast("double").cast(t).alias(name))
        else:
            cols.append(c.cast(t).alias(name))
    return df.select(*cols)


def _bare(path: str) -> str:
    """A path without its store."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)


def read_headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """(columns, whether a quoted line break splits the header) -> the files with that header.

    One job for all files: the first line of each comes from a text scan, and only distinct headers with
    the names of their files reach the driver.  A file without any line has no columns."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value",
        F.monotonically_increasing_id().alias("nth"))
    first = lines.filter("at = 0").groupBy("path").agg(F.min_by("value", "nth").alias("header"))
    found: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for row in first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect():
        files, line = [unquote(p) for p in row["paths"]], row["header"].removeprefix("\ufeff").rstrip("\r")
        if line.count('"') % 2:
            for path in files:      # the header goes on in the next line
                whole = spark.read.option("multiLine", True).option("escape", "\"").csv(path).first()
                found.setdefault((tuple(whole or ()), True), []).append(path)
        else:
            found.setdefault((tuple(next(csv.reader([line]), ())), False), []).extend(files)
    seen = {_bare(p) for files in found.values() for p in files}
    if empty := [p for p in paths if _bare(p) not in seen]:
        found[(), False] = empty
    return found


def read_group_csvs(spark: SparkSession, paths: Sequence[str], types: dict[str, DataType] | None = None,
                    group_from_path: bool = True, label_col: str = "activity") -> DataFrame:
    """Read feature CSVs that may have different headers, one distributed
    scan per header, binding every value to its own file's header by name.

    The headers of all files come from one job (``read_headers``).  Files of one
    header are read together by Spark's CSV reader, which parses quotes, checks every
    file's header against the schema and fails on a line with too few or too
    many fields.  The parts are cast and joined by column name; files without
    some column give NULL there (the diagonal union).  A file without the label
    column, or with a column twice, is an error.
    """
    if not paths:
        raise FileNotFoundError("no feature files to read")
    types = feature_types() if types is None else types
    out = None
    for (header, broken), files in sorted(read_headers(spark, paths).items()):
        if label_col not in header:
            raise ValueError(f"{files[0]}: no column {label_col} in the header")
        if len(set(header)) < len(header):
            raise ValueError(f"{files[0]}: a column comes twice in the header")
        schema = StructType([StructField(c, StringType()) for c in header])
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", False) \
            .option("mode", "FAILFAST").option("escape", "\"").option("multiLine", broken).csv(files)
        if group_from_path:
            part = part.withColumn(GROUP_COLUMN, F.regexp_extract("_metadata.file_path", GROUP_FROM_PATH, 1))
        part = cast_by_name(part, types)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    known = [c for c in types if c in out.columns]
    last = [GROUP_COLUMN] if group_from_path else []
    extra = sorted(c for c in out.columns if c not in known and c not in last)
    return out.select(*[F.col(f"`{c}`") for c in [*known, *extra, *last]])


def load_group(spark: SparkSession, group: str, data_dir: str) -> DataFrame:
    """One group's file, cast and tagged with its id; a missing file raises."""
    df = read_group_csvs(spark, [group_path(data_dir, group)], group_from_path=False)
    return df.withColumn(GROUP_COLUMN, F.lit(group))


def group_range(prefix: str, lo: int, hi: int) -> list[str]:
    """Inclusive id range, e.g. ("csh", 101, 130)."""
    return [f"{prefix}{i}" for i in range(lo, hi + 1)]


def row_text(df: DataFrame) -> Column:
    """A text that only rows with equal values have: every value in its length, NULL apart from empty."""
    cells = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return F.concat_ws("|", *[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells])


def load_groups(spark: SparkSession, data_dir: str, groups: Sequence[str] | None = None,
                sample_fraction: float | None = None, seed: int = 42, id_col: str | None = None) -> DataFrame:
    """All groups (or the given ids; missing files skipped, none found raises),
    one lazy plan; ``sample_fraction`` draws an exact per-group sample."""
    listing = list_group_files(spark, data_dir)
    rows = listing.collect()   # one row per file: a metadata listing
    wanted = set(groups) if groups is not None else None
    paths = [r["path"] for r in rows if wanted is None or r[GROUP_COLUMN] in wanted]
    if not paths:
        raise FileNotFoundError(f"no feature files found under {data_dir}")
    df = read_group_csvs(spark, paths)
    if sample_fraction:
        from foldwise.operators.sampling import exact_group_sample
        if id_col is None:
            df = exact_group_sample(df.withColumn("__row", row_text(df)), GROUP_COLUMN, "__row", sample_fraction, seed).drop("__row")
        else:
            df = exact_group_sample(df, GROUP_COLUMN, id_col, sample_fraction, seed)
    return df


def save_processed(df: DataFrame, path: str, partition_by: Sequence[str] | None = (GROUP_COLUMN,),
                   mode: str = "overwrite") -> str:
    """Write a processed table as Parquet, partitioned by group so later
    per-group filters prune whole directories."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    """Lazy Parquet read; a missing path raises AnalysisException."""
    return spark.read.parquet(path)


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """Load a saved model by the class its own metadata names."""
    import importlib

    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession
    java = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())["class"]
    module, name = java.replace("org.apache.spark", "pyspark").rsplit(".", 1)
    if not module.startswith("pyspark.ml"):
        raise ValueError(f"{path} holds a {java}, not a Spark ML model")
    package = ".".join(module.split(".")[:3])
    return getattr(importlib.import_module(package), name).load(path)


def load_sampled_dataset(spark: SparkSession, data_dir: str, sample_fraction: float, seed: int = 42,
                         mapping: dict[str, str] | None = None) -> DataFrame:
    """One lazy plan: scan every group's file, strip resident prefixes, drop
    the catch-all label, add the general label, then draw an exact per-group
    sample (nothing is collected; the reference collected each home first)."""
    from foldwise.functions.labels import clean_and_generalise
    df = clean_and_generalise(load_groups(spark, data_dir), mapping=mapping)
    if sample_fraction and sample_fraction < 1:
        from foldwise.operators.sampling import exact_group_sample
        df = exact_group_sample(df.withColumn("__row", row_text(df)), GROUP_COLUMN, "__row", sample_fraction, seed).drop("__row")
    return df
