import json
import os

from foldwise.operators import registry as R

# Fixed values of the reference, F4 run records: (timestamp, api, sample, score, train macro-F1, train accuracy, classes)
RUNS = [
    ("20260409_214833", "native", 0.4, 0.777179, 0.808790, 0.830370, 11),
    ("20260408_221358", "sklearn", 0.01, 0.622095, 0.760742, 0.863762, 11),
    ("20260408_215753", "sklearn", 0.01, 0.615708, 0.760742, 0.863762, 11),
    ("20260408_215912", "native", 0.005, 0.5938195, 0.758283, 0.856334, 11),
    ("20260408_221512", "native", 0.005, 0.5829465, 0.761535, 0.859056, 11),
    ("20260409_215520", "sklearn", 0.001, 0.481431, 0.929545, 0.988226, 10),
    ("20260409_215447", "native", 0.001, 0.444531, 0.549934, 0.747411, 10),
    ("20260408_221101", "sklearn", 0.01, "NaN", 0.760742, 0.863762, 11),
]


def _write(d):
    os.makedirs(f"{d}/models/checkpoints", exist_ok=True)
    for ts, api, frac, score, f1, acc, k in RUNS:
        details = {"best_params": {"learning_rate": 0.03, "max_depth": 6, "alpha": 0.1},
                   "early_stopping_rounds": 40, "final_num_boost_round": 900}
        if ts in ("20260409_214833", "20260409_215447"):
            details["checkpoint_path"] = f"models/checkpoints/ck_{ts}.json"
            with open(f"{d}/models/checkpoints/ck_{ts}.json", "w") as fh:
                json.dump({"api": api, "n_folds": 2, "trial_history": [{"trial": 1, "macro_f1": 0.5}]}, fh)
        rec = {"timestamp": ts, "api": api, "target_column": "activity_general", "sample_fraction": frac,
               "metric_primary_cv": 0.0, "train_metrics": {"train_f1_macro": f1, "train_accuracy": acc},
               "classes": [f"c{i}" for i in range(k)], "details": details}
        text = json.dumps(rec, indent=2).replace('"metric_primary_cv": 0.0', f'"metric_primary_cv": {score}')
        with open(f"{d}/models/meta_{ts}.json", "w") as fh:
            fh.write(text)
    with open(f"{d}/models/meta_truncated.json", "w") as fh:
        fh.write('{"timestamp": "20260410_000000", "api": "native", "metric_primary_cv": 0.99')
    with open(f"{d}/models/meta_noclasses.json", "w") as fh:
        json.dump({"timestamp": "20260410_000001", "api": "native", "target_column": "activity_general",
                   "metric_primary_cv": 0.95}, fh)


def test_leaderboard_golden(spark, tmpdir_path):
    _write(tmpdir_path)
    rec = R.read_run_records(spark, f"{tmpdir_path}/models/meta_*.json")
    ck = R.read_checkpoints(spark, f"{tmpdir_path}/models/checkpoints/*.json")
    runs = R.runs_table(rec, ck)
    assert runs.count() == 9  # truncated file skipped
    lb = R.leaderboard(runs).orderBy("rank").collect()
    assert [r.cv_macro_f1 for r in lb] == ["0.7772", "0.6221", "0.6157", "0.5938", "0.5829"]
    assert [r.sample_fraction for r in lb] == ["0.4", "0.01", "0.01", "0.005", "0.005"]
    assert lb[0].model == "XGBoost native" and lb[0].is_leader
    assert lb[0].target_label == "Generalized activities (11 classes)"
    assert [r.train_accuracy for r in lb] == ["0.8304", "0.8638", "0.8638", "0.8563", "0.8591"]
    folds = {r.timestamp: r.cv_folds for r in runs.collect()}
    assert folds["20260409_214833"] == 2 and folds["20260409_215447"] == 2
    assert folds["20260408_221358"] is None
    lead = R.leader_block(runs).first()
    assert lead.learning_rate == "0.030" and lead.rounds == 900 and lead.reg_alpha == "0.1"
    trials = R.trials_table(ck)
    assert trials.count() == 2


def test_resume_anti_join(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "fold int")
    done = spark.createDataFrame([(2, 0.5)], "fold int, acc double")
    assert sorted(r.fold for r in R.unfinished(units, done, ["fold"]).collect()) == [1, 3]


def test_run_record_round_trip(spark, tmpdir_path):
    rec = R.make_run_record(spark, timestamp="20260101_000000", api="native", target_column="activity_general",
                            metric_primary_cv=0.5, classes=[f"c{i}" for i in range(11)])
    R.append_run(rec, f"{tmpdir_path}/runs")
    R.append_run(rec, f"{tmpdir_path}/runs")
    back = spark.read.schema(R.RUN_RECORD_SCHEMA).json(f"{tmpdir_path}/runs")
    assert back.count() == 2
    runs = R.runs_table(back.withColumn("source_file", back["timestamp"]))
    assert R.comparable_runs(runs).count() == 2


def test_a_checkpoint_is_found_by_its_path(spark, tmpdir_path):
    import json
    import os
    for folder, n in (("a", 2), ("b", 5)):
        os.makedirs(f"{tmpdir_path}/ck/{folder}", exist_ok=True)
        with open(f"{tmpdir_path}/ck/{folder}/run one+x.json", "w") as f:      # one name in two folders
            json.dump({"api": "native", "n_folds": n}, f)
    with open(f"{tmpdir_path}/ck/a/only.json", "w") as f:
        json.dump({"api": "native", "n_folds": 7}, f)
    checks = R.read_checkpoints(spark, f"{tmpdir_path}/ck/*/*.json")
    asked = {"ck/a/run one+x.json": 2, "./b//run one+x.json": 5, "run one+x.json": None, "/old/place/only.json": 7, "none.json": None, None: None}
    rows = [(str(i), (p,)) for i, p in enumerate(asked)]
    records = spark.createDataFrame(rows, "timestamp string, details struct<checkpoint_path:string>")
    records = spark.read.schema(R.RUN_RECORD_SCHEMA).json(records.toJSON())
    table = R.runs_table(records.withColumn("source_file", records["timestamp"]), checks).collect()
    assert {r["checkpoint_path"]: r["cv_folds"] for r in table} == asked and len(table) == len(asked)


def test_bootstrap_interval_is_close_to_the_normal_one(spark):
    import random
    r = random.Random(4)
    per = spark.createDataFrame([(f"h{i}", r.gauss(0.6, 0.1)) for i in range(150)], "home_id string, accuracy double")
    a, b = (R.bootstrap_interval(per, "accuracy", "home_id", 400).first() for _ in range(2))
    want = R.fold_interval(per).first()
    assert a == b and a["n_boot"] == 400
    assert abs(a["mean"] - want["mean"]) < 0.003 and abs(a["low"] - want["low"]) < 0.006 and abs(a["high"] - want["high"]) < 0.006
    sums = R.bootstrap_sums(per, "accuracy", "home_id", 400).collect()
    assert abs(sum(s["weight"] for s in sums) / 400 / 150 - 1) < 0.02
    assert R.bootstrap_interval(per.limit(0), "accuracy", "home_id").first()["low"] is None
