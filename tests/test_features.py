import pytest
from pyspark.sql import functions as F

from foldwise.functions import features as FE
from foldwise.schema import feature_schema, FEATURE_ORDER


def _row(spark):
    base = {c: 0.0 for c in FEATURE_ORDER}
    base.update({"lastSensorEventHours": 19, "lastSensorEventSeconds": 0, "lastSensorDayOfWeek": 5,
                 "prevDominantSensor1": 0, "prevDominantSensor2": 0, "lastSensorID": 0,
                 "sensorCount-Kitchen": 2.0, "sensorCount-Bedroom": 0.0, "sensorCount-Bathroom": 1.0,
                 "sensorCount-LivingRoom": 0.0, "sensorCount-OutsideDoor": 0.0,
                 "timeSinceLastSensorEvent": 10.0, "lastMotionLocation": -1, "lastSensorLocation": 3,
                 "numDistinctSensors": 0,
                 "sensorElTime-Bathroom": 100.0, "sensorElTime-Bedroom": 86400.0, "sensorElTime-Kitchen": 5.0,
                 "sensorElTime-LivingRoom": 300.0, "sensorElTime-OutsideDoor": 299.0})
    base["activity"] = "Sleep"
    base["home_id"] = "csh101"
    schema = feature_schema()
    return spark.createDataFrame([tuple(base[f.name] for f in schema.fields)], schema)


def test_fixture_values(spark):
    out = FE.preprocess_features(_row(spark)).first().asDict()
    exp = dict(hour_sin=-0.965926, hour_cos=0.258819, dow_sin=-0.974928, dow_cos=-0.222521, Kitchen_x_hour=38,
               Kitchen_x_recency=20, is_evening=1, is_weekend=1, total_main_activity=3, kitchen_dominance=0.5,
               bedroom_dominance=0, has_motion=0, motion_matches_sensor=0, min_elapsed_time=5,
               recent_active_locations=3)
    for k, v in exp.items():
        assert out[k] == pytest.approx(v, abs=1e-6), k


def test_63_features(spark):
    out = FE.preprocess_features(_row(spark))
    feats = FE.numeric_feature_columns(out)
    assert len(feats) == 63
    assert "numDistinctSensors" not in out.columns


def test_drop_constant_requires_column(spark):
    with pytest.raises(ValueError):
        FE.drop_constant_features(spark.createDataFrame([(1,)], "a int"))


def test_null_handling(spark):
    df = spark.createDataFrame([(None, 100.0, 400.0, 5.0, 1.0)], "a double, b double, c double, d double, e double")
    cols = FE.elapsed_columns(locations=["a", "b", "c", "d", "e"], prefix="")
    r = df.select(*[v.alias(k) for k, v in cols.items()]).first()
    assert r.min_elapsed_time == 1.0
    assert r.recent_active_locations == 3


def test_feature_selection_errors_when_empty(spark):
    with pytest.raises(ValueError):
        FE.numeric_feature_columns(spark.createDataFrame([("x",)], "a string"))
