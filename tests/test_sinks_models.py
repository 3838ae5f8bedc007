import os

from pyspark.sql import functions as F

from foldwise.operators import metrics as M
from foldwise.operators import registry as R
from foldwise.operators import splits
from foldwise.operators import train as T
from foldwise.sources import files, sinks


def test_sinks_round_trip(spark, tmpdir_path):
    pred = spark.createDataFrame([("h1", "A", "A"), ("h1", "A", "B"), ("h2", "B", "B"), ("h2", "C", "A")],
                                 "home_id string, y string, p string")
    conf = M.confusion_long(pred, "y", "p", ["home_id"])
    sinks.write_confusion_matrices(conf, ["A", "B", "C"], f"{tmpdir_path}/cm")
    agg = spark.read.option("header", True).csv(f"{tmpdir_path}/cm/aggregate")
    assert agg.count() == 3 and set(agg.columns) == {"actual", "pred_A", "pred_B", "pred_C"}
    per = spark.read.option("header", True).csv(f"{tmpdir_path}/cm/per_group")
    assert sorted(r.home_id for r in per.select("home_id").distinct().collect()) == ["h1", "h2"]
    sinks.write_confusion_matrices(conf, ["A", "B", "C"], f"{tmpdir_path}/cm2", per_group_files=True)
    apart = spark.read.option("header", True).csv(f"{tmpdir_path}/cm2/per_group").select(per.columns)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, per.collect()))

    prob = F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1))
    table = sinks.prediction_table(pred, ["A", "B", "C"], prob, "y", "p", keep=["home_id"])
    sinks.write_predictions(table, f"{tmpdir_path}/pred")
    back = spark.read.parquet(f"{tmpdir_path}/pred")
    assert back.filter("correct").count() == 2 and "prob_C" in back.columns

    imp = spark.createDataFrame([(0, "x", 0.5), (1, "x", 0.7), (0, "z", 0.1), (1, "z", 0.3)],
                                "fold int, feature string, importance double")
    sinks.write_importance(imp, f"{tmpdir_path}/imp", top=1)
    top = spark.read.json(f"{tmpdir_path}/imp/top").collect()
    assert len(top) == 1 and top[0].feature == "x"

    folds = spark.createDataFrame([(0, 0.5, 0.4), (1, 0.7, 0.6)], "fold int, accuracy double, f1_macro double")
    sinks.write_cv_results(folds, R.cv_summary(folds), f"{tmpdir_path}/cv")
    assert spark.read.json(f"{tmpdir_path}/cv/summary").first().n_folds == 2


def test_early_stopping_and_model_io(spark, tmpdir_path):
    import random
    rnd = random.Random(5)
    rows = [(rnd.random(), rnd.choice(["a", "b", "c"]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y string, id int")
    df = splits.stratified_holdout(df, "y", "id", fraction=0.2)
    data, _ = T.prepare(df, ["x"], "y", keep=["is_val"])
    est = T.make_classifier("ovr_gbt", {"n_estimators": 20, "max_depth": 2}, validation_col="is_val")
    model = est.fit(data)
    # labels are noise: the validation loss stops improving long before 20 trees
    assert all(m.getNumTrees < 20 for m in model.models)
    path = files.save_model(model, f"{tmpdir_path}/model")
    again = files.load_model(path)
    a = model.transform(data).select("prediction").collect()
    b = again.transform(data).select("prediction").collect()
    assert a == b


def test_cv_results_hold_config_classes_and_features(spark, tmpdir_path):
    folds = spark.createDataFrame([(0, 0.5, 0.4), (1, 0.7, 0.6)], "fold int, accuracy double, f1_macro double")
    config = {"sample_fraction": 0.4, "params": {"max_depth": 6}}
    sinks.write_cv_results(folds, R.cv_summary(folds), f"{tmpdir_path}/cv", config, ["b", "a"], ["x", "z", "hour"])
    row = spark.read.json(f"{tmpdir_path}/cv/config").first().asDict(recursive=True)
    assert row == config
    assert [r["class"] for r in spark.read.json(f"{tmpdir_path}/cv/classes").orderBy("position").collect()] == ["b", "a"]
    assert [r.feature for r in spark.read.json(f"{tmpdir_path}/cv/features").orderBy("position").collect()] == ["x", "z", "hour"]
    assert spark.read.json(f"{tmpdir_path}/cv/summary").first().n_features == 3
