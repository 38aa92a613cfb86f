import os
import time

import pytest
from pyspark.sql import functions as F

from creditloom.catalog import models, records
from creditloom.operators.metrics import averaged_metrics
from creditloom.operators.sizing import COMPILED, settings, settle, settled
from creditloom.plans import cascade as C
from creditloom.plans.calibration import Calibrated, calibrate
from creditloom.plans.model_search import Task, fit_candidate, holdout_score, search
from creditloom.plans.model_stages import MODELS, Fitted, PipelineConfig, SelectAndClassify, make_classifier, search_space

FEATURES = ["f0", "f1", "f2", "f3"]
TASK = Task("y", "id", FEATURES, [])
FAST = {"n_estimators": 5, "max_depth": 3}


@pytest.fixture(scope="module")
def easy(spark):
    return spark.range(240).selectExpr(
        "id", "cast(id % 3 = 0 as int) y", "case when id % 3 = 0 then 1.0D else 0.0D end + (id * 37 % 101) / 200.0D f0",
            "(id * 53 % 97) / 97.0D f1", "(id * 71 % 89) / 89.0D f2", "cast(id % 2 as double) f3")


def f1(unit, df):
    return averaged_metrics(unit.transform(df), "y", "prediction").first()["macro_f1"]


def test_select_then_classify(spark, easy, tmp_path):
    unit = SelectAndClassify("RandomForestClassifier", "y", FEATURES, PipelineConfig(max_features=1, estimator=FAST)).fit_unit(easy)
    assert unit.selected == ["f0"] and f1(unit, easy) > 0.9
    rows = unit.transform(easy).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in rows)
    with pytest.raises(ValueError):
        unit.transform(easy.drop("f0"))
    unit.save(spark, str(tmp_path / "m"))
    assert f1(Fitted.load(spark, str(tmp_path / "m")), easy) == f1(unit, easy)
    none = SelectAndClassify("LogisticRegression", "y", FEATURES, PipelineConfig(max_features=None)).fit_unit(easy)
    assert none.selected == FEATURES
    one = SelectAndClassify("LogisticRegression", "y", FEATURES).fit_unit(easy.where("y = 1"))
    assert one.model is None and one.transform(easy).select("prediction").distinct().collect()[0][0] == 1


def test_rows_are_prepared_once_a_fit(spark, easy):
    """Selection and final fit each read the rows once, whatever passes their trees make."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    df = easy.withColumn("f0", F.udf(counted, "double")("f0"))
    unit = SelectAndClassify("RandomForestClassifier", "y", FEATURES, PipelineConfig(max_features=1, estimator=FAST)).fit_unit(df)
    assert unit.selected == ["f0"] and seen.value == 2 * 240
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_three_classes_one_vs_rest(easy):
    three = easy.withColumn("y", (F.col("id") % 3).cast("int"))
    cfg = PipelineConfig(max_features=None, estimator={"n_estimators": 2, "max_depth": 2})
    out = SelectAndClassify("XGBClassifier", "y", FEATURES, cfg).fit_unit(three).transform(three)
    assert all(len(r.probability) == 3 and abs(sum(r.probability) - 1) < 1e-9 for r in out.collect())


def test_names_are_translated():
    for m in MODELS:
        make_classifier(m, 3, {"n_estimators": 3, "max_depth": None} if "Tree" in m or "Forest" in m else {})
    assert make_classifier("LGBMClassifier", 2, {"learning_rate": 0.05, "n_estimators": 7}).getMaxIter() == 7
    assert "feature_selecting_classifier__estimator__depth" in search_space("CatBoostClassifier")


def test_search(spark, easy, tmp_path):
    p = "feature_selecting_classifier__"
    good = {"smote__enabled": False, f"{p}max_features": 2, f"{p}estimator__n_estimators": 3, f"{p}estimator__max_depth": 2}
    found = search(easy, TASK, {"RandomForestClassifier": [good], "Unknown": [good]}, k=3, sink=str(tmp_path / "r"), flush_every=1)
    rows = {r.model: r for r in found.results.collect()}
    assert rows["Unknown"].error and rows["Unknown"].mean_f1 is None
    assert found.best_model == "RandomForestClassifier" and rows["RandomForestClassifier"].mean_f1 > 0.7
    assert rows["RandomForestClassifier"].auc > 0.8 and spark.read.parquet(str(tmp_path / "r")).count() == 2
    assert found.worst.first()["worst_macro_f1"] <= found.best_score and found.fold_report.count() >= 4
    assert holdout_score(easy.where("id < 180"), easy.where("id >= 180"), TASK, "RandomForestClassifier", good) > 0.7


def test_killed_search_goes_on(spark, easy, tmp_path, monkeypatch):
    from creditloom.plans import model_search as S

    p = "feature_selecting_classifier__"
    make = lambda n: {"smote__enabled": False, f"{p}max_features": n, f"{p}estimator__n_estimators": 2, f"{p}estimator__max_depth": 2}
    plan = {"RandomForestClassifier": [make(1), make(2), make(1)], "Unknown": [make(1)]}
    calls, real = [], S.evaluate_candidate

    def counted(folded, task, model, *rest, **named):
        calls.append(model)
        return real(folded, task, model, *rest, **named)

    def killed(*a, **named):
        if calls:
            raise KeyboardInterrupt
        return counted(*a, **named)

    train, test = easy.where("id < 180"), easy.where("id >= 180")
    run = lambda name, **more: search(train, TASK, plan, k=2, sink=str(tmp_path / name), flush_every=1, test=test, with_auc=False, **more)
    whole = run("whole")
    monkeypatch.setattr(S, "evaluate_candidate", killed)
    with pytest.raises(KeyboardInterrupt):
        run("cut")
    assert spark.read.parquet(str(tmp_path / "cut")).count() == 1
    calls.clear()
    monkeypatch.setattr(S, "evaluate_candidate", counted)
    again = run("cut", resume=True)
    assert calls == ["RandomForestClassifier", "Unknown"]  # the first candidate and its repetition are known
    same = lambda found: [{k: v for k, v in r.asDict().items() if k not in ("timestamp", "fit_seconds")} for r in found.results.orderBy("ordinal").collect()]
    assert same(again) == same(whole) and len(same(whole)) == 4
    assert again.best_params == whole.best_params and again.fold_report.collect() == whole.fold_report.collect()
    assert all(r["test_f1"] is not None for r in same(whole)[:3]) and same(whole)[3]["test_f1"] is None
    calls.clear()
    once_more = run("cut", resume=True)
    assert calls == [] and once_more.worst.collect() == whole.worst.collect()
    run("cut", resume=True, retry_failed=True)
    assert calls == ["Unknown"]
    with pytest.raises(ValueError):
        search(train, TASK, plan, resume=True)


def test_history(spark, tmp_path):
    from creditloom.sources.tables import append_history, read_history

    schema = "ordinal bigint, model string, params string, mean_f1 double, test_f1 double"
    rows = [(0, "b", "{}", 0.5, 0.4), (1, "a", "{}", float("nan"), None), (2, "b", "{}", 0.7, None), (3, "c", "{}", 0.7, 0.1)]
    path = str(tmp_path / "h")
    append_history(spark.createDataFrame(rows, schema), path, "t1", n=2)
    append_history(spark.createDataFrame(rows[:1], schema), path, "t2")
    append_history(spark.createDataFrame([], schema), path, "t3")
    append_history(spark.createDataFrame(rows[:2], schema), path, "t2")
    got = {r.run_ts: r for r in read_history(spark, path).collect()}
    assert got["t1"].models_present == ["a", "b", "c"] and got["t1"].models_without_valid == ["a"]
    assert [(t.place, t.model, t.mean_f1, t.test_f1) for t in got["t1"].top] == [(1, "b", 0.7, None), (2, "c", 0.7, 0.1)]
    assert (got["t2"].n_candidates, got["t2"].n_valid, len(got["t2"].top)) == (2, 1, 1)
    assert got["t3"].n_candidates == 0 and got["t3"].top == [] and got["t3"].models_present == []
    assert spark.read.parquet(f"{path}/results").groupBy("run_ts").count().count() == 2


def test_ledger_rows(spark):
    from creditloom.plans.ledger import KEY, planned_results, settled_rows, unfinished

    plan = spark.createDataFrame([("k1", 0), ("k2", 1), ("k1", 2), ("k3", 3)], f"{KEY} string, ordinal int")
    rows = spark.createDataFrame([("k1", 9, None, 1.0), ("k1", 9, 0.5, 3.0), ("k1", 9, 0.6, 2.0), ("k2", 1, float("nan"), 1.0)],
                                 f"{KEY} string, ordinal int, mean_f1 double, timestamp double")
    assert {r[KEY]: r.mean_f1 for r in settled_rows(rows).where("not isnan(mean_f1)").collect()} == {"k1": 0.6}
    assert [r.ordinal for r in unfinished(plan, rows).collect()] == [3]
    assert sorted(r.ordinal for r in unfinished(plan, rows, retry_failed=True).collect()) == [1, 3]
    assert sorted(r.ordinal for r in planned_results(plan, rows).collect()) == [0, 1, 2]


def test_calibration(spark, easy, tmp_path):
    fit = lambda d: fit_candidate(d, TASK, "RandomForestClassifier", PipelineConfig(smote_enabled=False, max_features=None, estimator=FAST))
    cal = calibrate(easy, "y", "id", fit, 2)
    assert all(c[0][0] > 0 for c in cal.curves) and f1(cal, easy) > 0.9
    cal.save(spark, str(tmp_path / "c"))
    assert f1(Calibrated.load(spark, str(tmp_path / "c")), easy) == f1(cal, easy)


def test_cascade(spark, easy, tmp_path):
    train = easy.withColumns({C.STATUS: F.col("y"), C.TIER: F.when(F.col("y") == 0, (F.col("id") % 2).cast("int")).otherwise(-1),
                              "record_id": F.col("id").cast("string")})
    cfg = PipelineConfig(smote_enabled=False, max_features=None, estimator=FAST)
    model = C.train_cascade(train, FEATURES, [], config=cfg, folds=2)
    rows = model.score(train).collect()
    assert all((r.tier_prediction is None) == (r.status_prediction != 0) for r in rows)
    model.save(spark, str(tmp_path / "k"))
    text = C.Cascade.load(spark, str(tmp_path / "k")).decisions(train).select("result").first()[0]
    assert '"predicted_class"' in text
    more = C.add_phase_probabilities(train, model.status, "status")
    assert {"status_p0", "status_p1"} <= set(more.columns)


def test_search_spaces_and_notes():
    from creditloom.operators.candidates import planned_candidates, search_size
    from creditloom.plans.model_stages import SEARCH_VALUES, parameter_notes

    assert [search_size(search_space(m)) for m in SEARCH_VALUES] == [28, 24, 23, 33, 33, 30]
    assert sum(planned_candidates(search_space(m), 0.1) for m in SEARCH_VALUES) == 20
    assert parameter_notes({"reg_alpha": 0.1, "reg_lambda": 0, "max_depth": 40}) == ["reg_alpha=0.1 has no counterpart", "depth 40 becomes 30"]
    assert PipelineConfig.from_candidate({"smote__min_improvement": 0.2}).min_improvement == 0.2
    with pytest.raises(ValueError):
        make_classifier("LGBMClassifier", 2, {"learnig_rate": 0.1})


def _shuffled(spark):
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(status.apply(i).getName().startswith("shuffle_") for i in range(status.size()))


def test_settled_rows_leave_nothing_behind(spark):
    before = _shuffled(spark)
    with settled(spark.range(100).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()) as rows:
        path = rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert len(rows.collect()) == 7 and os.path.isdir(path)
        kept = settle(rows.where("k < 3"))
    assert not os.path.exists(path) and len(kept.collect()) == 3
    for _ in range(20):
        if _shuffled(spark) <= before:
            break
        time.sleep(0.5)
    assert _shuffled(spark) <= before


def test_settings_of_several_threads_come_back(spark):
    name, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    with settings(spark, **COMPILED):
        with settings(spark, **COMPILED):
            pass
        assert spark.conf.get(name) == "8000"
    assert spark.conf.get(name) == before


def _orders(spark, folder):
    spark.sql("""select id as o_orderkey, if(id = 5, null, id * 7) as o_custkey, 'O' as o_orderstatus, id * 100.5 as o_totalprice, '2-HIGH' as o_orderpriority,
        timestamp '2020-01-02 00:00:00' as o_orderdate from range(8)""").write.parquet(f"{folder}/orders.parquet")
    spark.sql("""select id div 12 as l_orderkey, if(id = 30, null, id) as l_partkey, 3L as l_suppkey, cast(id % 7 as int) as l_linenumber,
        cast(id % 9 as double) as l_quantity, id * 321.5 as l_extendedprice, (id % 6) / 100D as l_discount, (id % 3) / 100D as l_tax,
        element_at(array('A', 'N', 'R'), cast(id % 3 + 1 as int)) as l_returnflag, if(id % 2 = 0, 'O', 'F') as l_linestatus from range(70)
        union all select 1, 9, 9, 1, 1D, 9D, 0D, 0.01D, f, 'F' from (select explode(array('R', 'N', 'A')) f)""").write.parquet(f"{folder}/lineitem.parquet")


def test_shortened_offers_give_the_same_text(spark, tmp_path):
    _orders(spark, tmp_path)
    got = sorted(str(r.line) for r in records.application_text(spark, str(tmp_path), shorten=True).collect())
    assert not any(sign in t for t in got for sign in records.OFFER_PARTS)
    assert sorted(str(r.line) for r in records.application_text(spark, str(tmp_path)).collect()) == got and len(got) == 8


def test_record_files_are_compressed(spark, tmp_path):
    _orders(spark, tmp_path)
    path = models._json_files(spark, str(tmp_path))
    assert {f[-7:] for f in os.listdir(path.removeprefix("file://")) if f.startswith("part-")} == {".txt.gz"}
    lines = [r.line or "" for r in records.application_text(spark, str(tmp_path)).collect()]
    assert sorted(r.value for r in spark.read.text(path).collect()) == sorted(lines)
