import pytest
from pyspark.sql import functions as F

from foldwise.functions import labels as L


def test_map_sizes():
    assert len(L.GENERAL_ACTIVITY_MAP) == 41
    assert len(set(L.GENERAL_ACTIVITY_MAP.values())) == 11
    g = L.grouped_activity_map()
    assert len(g) == 35
    assert len(set(g.values())) == 11


def test_prefix_and_maps(spark):
    df = spark.createDataFrame([("r1.Sleep",), ("r2.Dress",), ("Other_Activity",), ("Laundry",), ("Mystery",),
                                ("r3.Cook",)], "activity string")
    out = L.clean_and_generalise(df).orderBy("activity").collect()
    got = {(r.activity, r.activity_general) for r in out}
    assert got == {("Sleep", "Sleep_Rest"), ("Dress", "Hygiene"), ("Laundry", "Household"),
                   ("Mystery", "Mystery"), ("r3.Cook", "r3.Cook")}
    # slice variant gives the same cleaning
    sl = df.select(L.strip_resident_prefix_slice("activity").alias("a"),
                   L.strip_resident_prefix("activity").alias("b")).collect()
    assert all(r.a == r.b for r in sl)


def test_double_backslash_pattern_does_not_clean(spark):
    df = spark.createDataFrame([("r1.Sleep",)], "activity string")
    r = df.select(F.regexp_replace("activity", r"^r[12]\\.", "").alias("x")).first()
    assert r.x == "r1.Sleep"


def test_grouping_keeps_original_and_passes_through(spark):
    df = spark.createDataFrame([("Sleep",), ("Laundry",), ("Other_Activity",)], "activity string")
    out = {(r.activity_original, r.activity_grouped) for r in L.apply_activity_grouping(df).collect()}
    assert out == {("Sleep", "Sleeping"), ("Laundry", "Laundry"), ("Other_Activity", "Other")}


def test_strict_mapping_raises(spark):
    df = spark.createDataFrame([("Laundry",)], "activity string")
    with pytest.raises(Exception):
        L.apply_activity_grouping(df, on_unmapped="error").collect()


def test_join_lookup_matches_literal_map(spark):
    df = spark.createDataFrame([("Sleep",), ("Cook",), ("Nope",)], "activity string")
    m = spark.createDataFrame(list(L.GENERAL_ACTIVITY_MAP.items()), "k string, v string")
    a = {r.activity: r.g for r in L.map_labels_join(df, "activity", m, "k", "v", "g").collect()}
    assert a == {"Sleep": "Sleep_Rest", "Cook": "Meal_Prep", "Nope": "Nope"}
