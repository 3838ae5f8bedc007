"""Quality rules: a threshold table compiled into one Spark projection.

``measure`` adds the counts of a text, ``compile_rules`` turns a threshold
table into boolean columns over ratios of these counts.  Everything is a
per-row expression: no shuffle, no user function, whole texts.

Defined cases: a null or blank text has zero counts and fails the length
rule; a ratio over zero words or lines is 0; copies of a row get the same
verdict; extra columns pass through ``apply_rules`` (a column that has the
name of a measure is replaced by the measure).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import count_chars, let, require, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
# Frequent function words of the languages the default rules cover (fixed list).
STOP_WORDS = (
    "the be to of and that have with in it is was for on as at by this are or an "
    "der die das und ist in zu den mit von ein eine nicht auf für im des dem sich auch "
    "le la les de des et en un une du dans que est pour qui sur pas au avec ce "
    "el la los las de que y en un una se del por con no para su al es lo").split()
# as they are written: lower case, or with a capital
STOP_FORMS = sorted(set(STOP_WORDS) | {w.capitalize() for w in STOP_WORDS})


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low <= numerator / denominator <= high``."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


# The default threshold table (numerator and denominator are measures).
DEFAULT_RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 25.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.10),
    Rule("upper_case", "n_upper", "word_chars", None, 0.40),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.50),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_upper", "n_stop_words", "n_lines")


def _windows(w: Column, window: int) -> Column:
    """Hashes of all windows: of half a window of words first, then of two
    halves; what runs over the end goes."""
    half = window // 2
    halves = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + d) for d in range(1, half)]))
    rest = list(range(2 * half, window))
    return let(halves, lambda h: F.slice(
        F.transform(h, lambda v, i: F.xxhash64(v, F.get(h, i + half), *[F.get(w, i + d) for d in rest])),
        F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(0))))


def _repeat_words(hashes: Column, window: int) -> Column:
    """Number of words in windows that occur at least twice."""
    def same(s: Column, k: Column, d: int) -> Column:
        return F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))

    def places(s: Column) -> Column:
        repeated = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(s, k, -1) | same(s, k, 1))
        return F.sort_array(F.transform(repeated, lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0))
             .otherwise(let(ordered, lambda s: let(places(s), covered))))


def measure(df: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Add the measures of ``text_col`` as long columns.

    Windows are compared by a 64-bit hash of their words inside one text.
    """
    require(df, text_col)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in MEASURES]
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(t), lambda w: F.struct(
        F.size(w).alias("n_words"),
        F.length(F.array_join(w, "")).alias("word_chars"),
        let(_windows(w, window), lambda h: _repeat_words(h, window)).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_FORMS))).alias("n_stop_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"),
                                             (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = let(of_words, lambda w: let(of_lines, lambda x: F.array(F.struct(*[c.cast("bigint").alias(m) for m, c in {
        "n_words": w["n_words"], "word_chars": w["word_chars"], "n_symbols": count_chars(t, SYMBOLS),
        "n_dup_lines": x["n_dup_lines"], "n_repeat_words": w["n_repeat_words"],
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
        "n_stop_words": w["n_stop_words"], "n_lines": x["n_lines"]}.items()]))))
    # inline() is a fence: a filter on a measure is not moved below it, which would measure twice
    return df.select(*keep, F.inline(out))


def compile_rules(rules=DEFAULT_RULES) -> dict[str, Column]:
    """A boolean expression per rule: whether the text passes."""
    out = {}
    for r in rules:
        value = F.col(r.numerator).cast("double")
        if r.denominator:
            value = F.when(F.col(r.denominator) > 0, value / F.col(r.denominator)).otherwise(F.lit(0.0))
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (value >= F.lit(float(r.low)))
        if r.high is not None:
            ok = ok & (value <= F.lit(float(r.high)))
        out[r.name] = ok
    return out


def apply_rules(df: DataFrame, text_col: str = "text", rules=DEFAULT_RULES, min_words: int = 20,
                max_repeat_percent: int = 30) -> DataFrame:
    """Measures plus ``base_failed`` (too short, or too many words in repeated
    windows), ``failed_rules`` (names of the rules broken) and ``kept``."""
    df = measure(df, text_col)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in compile_rules(rules).items()]),
                      lambda x: x.isNotNull())
    df = df.withColumns({"base_failed": base, "failed_rules": broken})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def oracle(rules=DEFAULT_RULES) -> str:
    """DuckDB SQL for the query over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    oks = []
    for r in rules:
        value = f"CASE WHEN {r.denominator} > 0 THEN {r.numerator}::DOUBLE / {r.denominator} ELSE 0 END"
        oks += [f"{value} >= {r.low}"] if r.low is not None else []
        oks += [f"{value} <= {r.high}"] if r.high is not None else []
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM s WHERE len(w) >= {WINDOW}),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS c FROM p),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM g WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        ({count(SYMBOLS)})::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
        len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words, len(l) AS n_lines FROM s LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(f'({x})' for x in oks)} AS kept FROM b"""
