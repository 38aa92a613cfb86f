"""Model, scoring and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.records import OFFER_PIVOT_SQL, application_text, flat_records
from creditloom.catalog.tables import scratch, table
from creditloom.operators.balance import balance
from creditloom.operators.boosting import BoostSettings, fit_boosted
from creditloom.operators.ensembles import average_probabilities, majority_vote
from creditloom.operators.feature_scores import importance_table
from creditloom.operators.metrics import classification_report, log_loss
from creditloom.operators.sizing import COMPILED, FREED, settings, settle, settled
from creditloom.plans import cascade as C
from creditloom.plans.calibration import _calibrate, calibrate
from creditloom.plans.column_schema import default_schema, resolve_roles
from creditloom.plans.feature_table import feature_table, freeze_labels
from creditloom.plans.model_search import Task, fit_candidate, search
from creditloom.plans.model_stages import PipelineConfig, SelectAndClassify
from creditloom.sources.applications import parse_records, stream_records
from creditloom.streaming import jobs

SMALL = {"n_estimators": 10, "max_depth": 4}
TEXT_FEATURES = ["n_chars", "length", "words", "commas", "third"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def text_features(spark, sf):
    """Integer features of the labelled documents."""
    d = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.length("text").alias("length"), F.size(F.split("text", " ")).alias("words"),
        F.regexp_count("text", F.lit(",")).alias("commas"), (F.col("doc_id") % 3).cast("int").alias("third"))
    return d.join(table(spark, sf, "labels"), "doc_id")


TASK = Task("quality", "doc_id", TEXT_FEATURES, ["third"])


def importance_select(spark, sf):
    unit = SelectAndClassify("RandomForestClassifier", "l_returnflag", LINE_FEATURES,
                             PipelineConfig(max_features=3, estimator=SMALL)).fit_unit(table(spark, sf, "lineitem"))
    return importance_table(spark, unit.selected, unit.weights)


def train_status(spark, sf):
    data = settle(text_features(spark, sf))
    unit = fit_candidate(data, TASK, "RandomForestClassifier", PipelineConfig(max_features=4, min_improvement=0.0, estimator=SMALL))
    return classification_report(unit.transform(data), "quality", "prediction")


def balanced_training(spark, sf):
    out = balance(text_features(spark, sf), "quality", "doc_id", TEXT_FEATURES, ["third"], method="smotenc", k=5)
    return out.groupBy("quality").agg(F.count("*").alias("n_rows"), F.count_if("synthetic").alias("n_synthetic"))


BALANCED_SQL = """with c as (select quality, count(*) k from labels join documents using (doc_id) group by 1)
select quality, max(k) over () n_rows, max(k) over () - k n_synthetic from c"""


def model_search(spark, sf):
    data = settle(text_features(spark, sf))
    prefix = "feature_selecting_classifier__"
    params = {"smote__method": "smote", "smote__k_neighbors": 3, f"{prefix}max_features": 3}
    found = search(data, TASK, {
        "RandomForestClassifier": [{**params, f"{prefix}estimator__n_estimators": 5, f"{prefix}estimator__max_depth": 3}],
        "LogisticRegression": [{"smote__enabled": False, f"{prefix}max_features": None}],
    }, k=3)
    return found.top(5)


def calibrated_score(spark, sf):
    data = settle(text_features(spark, sf))
    fit = lambda df: fit_candidate(df, TASK, "RandomForestClassifier", PipelineConfig(smote_enabled=False, max_features=None, estimator=SMALL))
    return log_loss(calibrate(data, "quality", "doc_id", fit, 3).transform(data), "quality", "probability")


def boosted_one_vs_rest(spark, sf):
    li = table(spark, sf, "lineitem")
    unit = SelectAndClassify("GradientBoostingClassifier", "l_returnflag", LINE_FEATURES,
                             PipelineConfig(max_features=None, estimator={"n_estimators": 2, "max_depth": 3})).fit_unit(li)
    return classification_report(unit.transform(li), "l_returnflag", "prediction")


def ensemble_votes(spark, sf):
    data = settle(text_features(spark, sf))
    cfg = PipelineConfig(smote_enabled=False, max_features=None, estimator=SMALL)
    out = data
    for i, m in enumerate(("RandomForestClassifier", "ExtraTreesClassifier", "LogisticRegression")):
        c = PipelineConfig(smote_enabled=False, max_features=None) if m == "LogisticRegression" else cfg
        out = fit_candidate(data, TASK, m, c).transform(out, f"m{i}_")
    soft = average_probabilities(out, ["m0_probability", "m1_probability", "m2_probability"]).withColumnRenamed("prediction", "soft")
    return majority_vote(soft, ["m0_prediction", "m1_prediction", "m2_prediction"]).select("doc_id", "soft", F.col("prediction").alias("hard"))


def _trained(spark, sf):
    with settings(spark, **COMPILED), settled(flat_records(spark, sf)) as flat:
        specs = freeze_labels(flat, default_schema())
        features = settle(feature_table(flat, specs))
    roles = resolve_roles(specs, features.columns, allow_missing=True)
    names = [f for f in roles.features if dict(features.dtypes)[f] != "string"]
    cfg = PipelineConfig(smote_enabled=False, max_features=8, estimator=SMALL)
    return C.train_cascade(features, names, roles.categorical, config=cfg, folds=2), features, specs


def cascade_score(spark, sf):
    model, features, _ = _trained(spark, sf)
    return model.score(features).select(F.col("record_id").cast("bigint").alias("record_id"), "status_prediction", "tier_prediction")


def batch_decisions(spark, sf):
    model, _, specs = _trained(spark, sf)
    records = parse_records(application_text(spark, sf), "line")
    return C.score_records(records, model, specs).select("record_id", "status_prediction.predicted_class", "tier_prediction.predicted_tier")


def _json_files(spark, sf) -> str:
    path = scratch(spark, "records")
    with settings(spark, **FREED):
        application_text(spark, sf, shorten=True).write.option("compression", "gzip").text(path)
    return path


def stream_score(spark, sf):
    model, _, specs = _trained(spark, sf)
    out = scratch(spark, "decisions")
    q = jobs.stream_decisions(stream_records(spark, _json_files(spark, sf)), model, specs, out, scratch(spark, "state"), once=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("record_id", "result")


def stream_features(spark, sf):
    specs = freeze_labels(flat_records(spark, sf, shorten=True), default_schema())
    out = scratch(spark, "features")
    q = jobs.stream_features(stream_records(spark, _json_files(spark, sf)), specs, out, scratch(spark, "state"), once=True)
    q.awaitTermination()
    f = spark.read.parquet(out)
    return f.select(F.col("record_id").cast("bigint").alias("record_id"), *[F.col(f"{p}_{s}").alias(f"{a}_{s.strip('_').lower()}") for p, a in
                    (("0UnsecuredFunding", "uf"), ("DebtResolution", "dr")) for s in ("missing_", "Status", "Amount")])


STREAM_FEATURES_SQL = f"select record_id, uf_missing, uf_status, uf_amount, dr_missing, dr_status, dr_amount from ({OFFER_PIVOT_SQL})"


def stream_balance(spark, sf):
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = scratch(spark, "balance")
    jobs.stream_balance(events, "ts", "event_type", out, scratch(spark, "state"), once=True).awaitTermination()
    return jobs.current_balance(spark, out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "label", "n_rows")


CURVES = [(2.5, -1.0), (-0.5, 0.25), (4.0, -2.0)]


def calibration_formula(spark, sf):
    """Fixed sigmoids on given class scores: three classes, and the two-class form."""
    p = F.array(*[F.col(c) for c in ("l_discount", "l_tax")], F.lit(1.0) - F.col("l_discount") - F.col("l_tax"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _calibrate(p, CURVES).alias("c"),
                                             _calibrate(F.array(1 - F.col("l_discount"), F.col("l_discount")), CURVES[:1]).alias("d"))
    return li.select("l_orderkey", "l_linenumber", *[F.round(F.get("c", i), 9).alias(f"c{i}") for i in range(3)],
                     *[F.round(F.get("d", i), 9).alias(f"d{i}") for i in range(2)])


CALIBRATION_SQL = """
with s as (select l_orderkey, l_linenumber, 1 / (1 + exp(-(2.5 * l_discount - 1.0))) a, 1 / (1 + exp(-(-0.5 * l_tax + 0.25))) b,
  1 / (1 + exp(-(4.0 * (1 - l_discount - l_tax) - 2.0))) c from lineitem)
select l_orderkey, l_linenumber, round(a / (a + b + c), 9) c0, round(b / (a + b + c), 9) c1, round(c / (a + b + c), 9) c2,
  round(1 - a, 9) d0, round(a, 9) d1 from s
"""


def majority_votes(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("a"),
                                             (F.col("l_suppkey") % 3).alias("b"), (F.col("l_linenumber") % 3).alias("c"))
    return majority_vote(li, ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "prediction")


VOTES_SQL = """
with v as (select l_orderkey, l_linenumber, l_partkey % 3 a, l_suppkey % 3 b, l_linenumber % 3 c from lineitem)
select l_orderkey, l_linenumber, (case when a = b or a = c then a when b = c then b else least(a, b, c) end)::int prediction from v
"""


class Given:
    """A phase whose prediction and probabilities are columns already there."""

    def __init__(self, classes, prediction, probability):
        self.classes, self.prediction, self.probability = classes, prediction, probability

    def transform(self, df, prefix=""):
        return df.withColumns({f"{prefix}prediction": self.prediction, f"{prefix}probability": self.probability})


def cascade_rule(spark, sf):
    """Decisions from given predictions: names, and no tier unless approved."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey")
    share = (F.col("o_custkey") % 10) / 10
    status = Given([0, 1], (F.col("record_id") % 2).cast("int"), F.array(1 - share, share))
    tier = Given([0, 1, 2], (F.col("record_id") % 3).cast("int"), F.array(share / 2, share / 2, 1 - share))
    out = C.Cascade(status, tier).decisions(o)
    return out.select("record_id", F.col("status_prediction.predicted_class").alias("status"), F.col("tier_prediction.predicted_tier").alias("tier"),
                      F.round(F.col("status_prediction.probabilities")["declined"], 6).alias("p_declined"),
                      F.round(F.col("tier_prediction.probabilities")["Tier 3"], 6).alias("p_tier_3"))


CASCADE_SQL = """
select o_orderkey record_id, case when o_orderkey % 2 = 0 then 'approved' else 'declined' end as status,
  case when o_orderkey % 2 = 0 then 'Tier ' || (o_orderkey % 3 + 1) end tier, round((o_custkey % 10) / 10, 6) p_declined,
  case when o_orderkey % 2 = 0 then round(1 - (o_custkey % 10) / 10, 6) end p_tier_3 from orders
"""


def cascade_invariants(spark, sf):
    """A trained cascade over all records: rows scored, probabilities that sum to one, tiers only where approved."""
    model, features, _ = _trained(spark, sf)
    s = model.score(features)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    approved = F.col("status_prediction") == 0
    return s.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(total("status_probability") - 1) < 1e-9).alias("n_status_sums"),
                 F.count_if(F.when(approved, F.abs(total("tier_probability") - 1) < 1e-9).otherwise(F.col("tier_probability").isNull())).alias("n_tier_sums"),
                 F.count_if(approved == F.col("tier_prediction").isNotNull()).alias("n_tier_rule"))


# Effective regularisation: every setting changes which cuts are allowed or what leaves are worth.
FIRST_TREE = {"rounds": 1, "num_leaves": 4, "max_depth": 2, "reg_alpha": 0.5, "reg_lambda": 3.0, "gamma": 0.05, "min_child_weight": 1.0, "learning_rate": 0.3}
MARKS = {"bars": "|", "calls": "!", "dollars": "$", "stars": "*"}


def mark_counts(spark, sf):
    """Labelled documents with how often some marks occur in their texts, up to 20."""
    d = table(spark, sf, "documents").select("doc_id", *[
        F.least(F.length("text") - F.length(F.replace("text", F.lit(m), F.lit(""))), F.lit(20)).cast("double").alias(name) for name, m in MARKS.items()])
    return d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


MARKS_SQL = "select doc_id, quality as y, [" + ", ".join(
    f"least(length(text) - length(replace(text, '{m}', '')), 20)::double" for m in MARKS.values()) + "] as x from documents join labels using (doc_id)"


def boosted_first_tree(spark, sf):
    """Cuts, gains and leaf values of the first boosted tree on all labelled documents."""
    model = fit_boosted(mark_counts(spark, sf), list(MARKS), "quality", BoostSettings(**FIRST_TREE))
    got = spark.createDataFrame(model.rows(), "round int, output int, path string, feature string, cut double, gain double, value double")
    return got.select("path", "feature", "cut", "gain", "value")


_STRENGTH = "(power(greatest(abs({g}) - 0.5, 0), 2) / ({h} + 3))"
_SPLIT = """{name}_s as (select node, f, v, sum(g) over u gl, sum(h) over u hl, sum(g) over p gt, sum(h) over p ht
  from (select node, f, v, sum(0.5::double - y) g, count(*) * 0.25::double h from {source} group by all)
  window u as (partition by node, f order by v), p as (partition by node, f)),
{name} as (select *, 0.5 * ({left} + {right} - {whole}) gain from {name}_s where hl >= 1 and ht - hl >= 1 and gain > 0.05
  qualify row_number() over (partition by node order by gain desc, f, v) = 1)"""


def _split_sql(name: str, source: str) -> str:
    sides = {"left": ("gl", "hl"), "right": ("(gt - gl)", "(ht - hl)"), "whole": ("gt", "ht")}
    return _SPLIT.format(name=name, source=source, **{k: _STRENGTH.format(g=g, h=h) for k, (g, h) in sides.items()})


FIRST_TREE_SQL = f"""with d as ({MARKS_SQL}),
base as (select '' as node, x, y, f, x[f] v from d, unnest([1, 2, 3, 4]) as t(f)), {_split_sql('root', 'base')},
deeper as (select case when base.x[root.f] <= root.v then 'L' else 'R' end as node, base.y, base.f, base.v from base, root), {_split_sql('kids', 'deeper')},
cuts as (select * from root union all select * from kids),
halves as (select node || side as path, case when side = 'L' then gl else gt - gl end as g, case when side = 'L' then hl else ht - hl end as h
  from cuts, unnest(['L', 'R']) as t(side))
select node as path, {list(MARKS)}[f] as feature, v as cut, gain, null::double as value from cuts
union all select path, null, null, null, -0.3 * sign(g) * greatest(abs(g) - 0.5, 0) / (h + 3) from halves where path not in (select node from cuts)"""


def boosted_scores(rows):
    """Two thirds of the labelled documents teach, the others are scored."""
    model = fit_boosted(rows.where("doc_id % 3 != 0"), list(MARKS), "quality", BoostSettings(rounds=5, num_leaves=8, learning_rate=0.5))
    return model.predict(rows.where("doc_id % 3 = 0"))


def boosted_holdout(spark, sf):
    """Held-out documents scored by boosting: all of them, those whose probabilities add up to one, those whose
    prediction is the likelier class."""
    scored = boosted_scores(mark_counts(spark, sf))
    sums = F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
    likelier = F.col("prediction") == (F.get("probability", 1) > F.get("probability", 0)).cast("int")
    return scored.agg(F.count("*").alias("n_rows"), F.count_if(sums).alias("n_sums"), F.count_if(likelier).alias("n_likelier"))


QUERIES = {
    "boosted_first_tree": (boosted_first_tree, FIRST_TREE_SQL),
    "boosted_holdout": (boosted_holdout, "select count(*) as n_rows, count(*) as n_sums, count(*) as n_likelier from documents join labels using (doc_id) where doc_id % 3 = 0"),
    "calibration_formula": (calibration_formula, CALIBRATION_SQL),
    "majority_votes": (majority_votes, VOTES_SQL),
    "cascade_rule": (cascade_rule, CASCADE_SQL),
    "cascade_invariants": (cascade_invariants, "select count(*) n_rows, count(*) n_status_sums, count(*) n_tier_sums, count(*) n_tier_rule from orders"),
    "importance_select": (importance_select, None),
    "train_status": (train_status, None),
    "balanced_training": (balanced_training, BALANCED_SQL),
    "model_search": (model_search, None),
    "calibrated_score": (calibrated_score, None),
    "boosted_one_vs_rest": (boosted_one_vs_rest, None),
    "ensemble_votes": (ensemble_votes, None),
    "cascade_score": (cascade_score, None),
    "batch_decisions": (batch_decisions, None),
    "stream_score": (stream_score, None),
    "stream_features": (stream_features, STREAM_FEATURES_SQL),
    "stream_balance": (stream_balance, "select strftime(ts, '%Y-%m-%d') as day, event_type as label, count(*) n_rows from events group by 1, 2"),
}
