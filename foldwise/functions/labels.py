"""Label cleaning, generalisation and indexing (column expressions).

Everything here is a JVM-side column expression: a map lookup is a
``create_map`` literal, so no join and no shuffle is needed however large the
labelled table grows.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for matching results.
# ---------------------------------------------------------------------------

# Resident prefix on raw labels ("r1.Sleep" -> "Sleep").
RESIDENT_PREFIX_PATTERN = r"^r[12]\."

# Catch-all label dropped before training.
CATCH_ALL_LABEL = "Other_Activity"

# 41 raw activities -> 11 general activities ("activity_general").
GENERAL_ACTIVITY_MAP: dict[str, str] = {
    "Bathe": "Hygiene",
    "Personal_Hygiene": "Hygiene",
    "Groom": "Hygiene",
    "Toilet": "Hygiene",
    "Bed_Toilet_Transition": "Hygiene",
    "Dress": "Hygiene",
    "Cook": "Meal_Prep",
    "Cook_Breakfast": "Meal_Prep",
    "Cook_Lunch": "Meal_Prep",
    "Cook_Dinner": "Meal_Prep",
    "Wash_Dishes": "Meal_Cleanup",
    "Wash_Breakfast_Dishes": "Meal_Cleanup",
    "Wash_Lunch_Dishes": "Meal_Cleanup",
    "Wash_Dinner_Dishes": "Meal_Cleanup",
    "Eat": "Eating",
    "Drink": "Eating",
    "Eat_Breakfast": "Eating",
    "Eat_Lunch": "Eating",
    "Eat_Dinner": "Eating",
    "Sleep": "Sleep_Rest",
    "Go_To_Sleep": "Sleep_Rest",
    "Wake_Up": "Sleep_Rest",
    "Nap": "Sleep_Rest",
    "Sleep_Out_Of_Bed": "Sleep_Rest",
    "Work": "Work_Study",
    "Work_On_Computer": "Work_Study",
    "Work_At_Desk": "Work_Study",
    "Work_At_Table": "Work_Study",
    "Exercise": "Exercise",
    "Read": "Leisure",
    "Phone": "Leisure",
    "Relax": "Leisure",
    "Watch_TV": "Leisure",
    "Entertain_Guests": "Leisure",
    "Morning_Meds": "Medication",
    "Evening_Meds": "Medication",
    "Take_Medicine": "Medication",
    "Enter_Home": "Home_Transition",
    "Leave_Home": "Home_Transition",
    "Step_Out": "Home_Transition",
    "Laundry": "Household",
}

# 35 raw activities -> 11 grouped activities ("activity_grouped").
GROUPED_ACTIVITIES: dict[str, list[str]] = {
    "Sleeping": ["Sleep", "Sleep_Out_Of_Bed", "Bed_Toilet_Transition"],
    "Cooking": ["Cook", "Cook_Breakfast", "Cook_Lunch", "Cook_Dinner"],
    "Eating": ["Eat", "Eat_Breakfast", "Eat_Lunch", "Eat_Dinner"],
    "Washing_Dishes": ["Wash_Dishes", "Wash_Breakfast_Dishes", "Wash_Lunch_Dishes", "Wash_Dinner_Dishes"],
    "Personal_Care": ["Bathe", "Toilet", "Personal_Hygiene", "Groom", "Dress"],
    "Medication": ["Morning_Meds", "Evening_Meds", "Take_Medicine"],
    "Leisure": ["Watch_TV", "Read", "Relax", "Phone", "Entertain_Guests"],
    "Work": ["Work_At_Table", "Work_At_Desk"],
    "Transitions": ["Enter_Home", "Leave_Home", "Step_Out"],
    "Drinking": ["Drink"],
    "Other": ["Other_Activity"],
}

# Expected class count per target column (used to keep comparable runs).
EXPECTED_CLASS_COUNTS: dict[str, int] = {"activity_general": 11, "activity": 41}

# ---------------------------------------------------------------------------


def grouped_activity_map() -> dict[str, str]:
    """Raw label -> grouped label, inverted from ``GROUPED_ACTIVITIES``."""
    return {raw: grp for grp, raws in GROUPED_ACTIVITIES.items() for raw in raws}


def strip_resident_prefix(col: Column | str) -> Column:
    """``r1.Sleep`` / ``r2.Sleep`` -> ``Sleep``; other values unchanged."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, RESIDENT_PREFIX_PATTERN, "")


def strip_resident_prefix_slice(col: Column | str) -> Column:
    """Same result as :func:`strip_resident_prefix` via prefix test + slice."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.substring(c, 1, 3).isin("r1.", "r2."), c.substr(F.lit(4), F.length(c))).otherwise(c)


def map_literal(mapping: dict[str, str]) -> Column:
    """A literal map column built from a small fixed dictionary."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(mapping.items()))])


def map_labels(col: Column | str, mapping: dict[str, str]) -> Column:
    """Dictionary lookup with pass-through for unmapped values (``replace``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.element_at(map_literal(mapping), c), c) if mapping else c


def map_labels_strict(col: Column | str, mapping: dict[str, str]) -> Column:
    """Dictionary lookup that fails the job on an unmapped non-NULL label."""
    c = F.col(col) if isinstance(col, str) else col
    looked = F.element_at(map_literal(mapping), c)
    return F.when(c.isNull(), F.lit(None)).when(looked.isNull(), F.raise_error(
        F.concat(F.lit("unmapped label: "), c))).otherwise(looked)


def map_labels_join(df: DataFrame, col: str, map_df: DataFrame, key: str, value: str,
                    out: str) -> DataFrame:
    """Lookup against a label table too large for a literal map.

    A label can hold a third of all rows: adaptive execution broadcasts the
    map when its measured bytes are few and splits hot partitions otherwise.
    """
    m = map_df.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return (df.join(m, df[col] == m["__k"], "left")
              .withColumn(out, F.coalesce(F.col("__v"), F.col(col)))
              .drop("__k", "__v"))


def apply_activity_grouping(df: DataFrame, label_col: str = "activity",
                            on_unmapped: str = "keep") -> DataFrame:
    """35 -> 11 grouping; keeps the raw label as ``activity_original``."""
    mapping = grouped_activity_map()
    expr = map_labels(label_col, mapping) if on_unmapped == "keep" else map_labels_strict(label_col, mapping)
    return df.withColumns({"activity_original": F.col(label_col), "activity_grouped": expr})


def clean_and_generalise(df: DataFrame, label_col: str = "activity",
                         mapping: dict[str, str] | None = None,
                         catch_all: str | None = CATCH_ALL_LABEL,
                         out_col: str = "activity_general") -> DataFrame:
    """Strip prefixes, drop the catch-all label, add the general label."""
    mapping = GENERAL_ACTIVITY_MAP if mapping is None else mapping
    out = df.withColumn(label_col, strip_resident_prefix(label_col))
    if catch_all is not None:
        out = out.filter(F.col(label_col) != F.lit(catch_all))
    return out.withColumn(out_col, map_labels(label_col, mapping))


def filter_labels_regex(df: DataFrame, label_col: str, pattern: str, keep: bool = True) -> DataFrame:
    """Keep (or drop) rows whose label contains a match of ``pattern``."""
    cond = F.col(label_col).rlike(pattern)
    return df.filter(cond if keep else ~cond)
