"""Splits, balance, metrics, feature scores, candidates and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.tables import scratch, table
from creditloom.operators import balance as B
from creditloom.operators import candidates as C
from creditloom.operators import feature_scores as S
from creditloom.operators import metrics as M
from creditloom.operators import quality as Q
from creditloom.operators import splits as P
from creditloom.operators.mutual_information import neighbour_mutual_info_scores
from creditloom.operators.nearest import nearest_in_group
from creditloom.operators.sizing import settle
from creditloom.operators.ensembles import average_probabilities
from creditloom.plans import ledger as L

U01 = "cast(('0x' || substr(md5({}), 1, 8)) as bigint) / 4294967296.0"


def labelled_docs(spark, sf):
    """documents joined with labels: integer text features and the class."""
    d = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.length("text").alias("length"), (F.col("doc_id") % 3).cast("int").alias("third"), "lang")
    return d.join(table(spark, sf, "labels"), "doc_id")


def class_balance(spark, sf):
    return B.class_counts(table(spark, sf, "events"), "event_type")


def minority_share(spark, sf):
    out = B.minority_share(table(spark, sf, "labels"), "quality")
    return out.withColumn("minority_share", F.round("minority_share", 6))


def class_weights(spark, sf):
    out = B.class_weights(table(spark, sf, "labels"), "quality")
    return out.select("doc_id", F.round("weight", 6).alias("weight"))


def stratum_counts(spark, sf):
    return P.stratum_counts(table(spark, sf, "labels"), ["quality", "toxic"])


def rare_strata(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate").cast("string"))
    return P.rare_strata(o, ["day", "o_orderpriority"]).select("o_orderkey", "day", "o_orderpriority")


def stratified_split(spark, sf):
    return P.train_test_split(table(spark, sf, "labels"), ["quality", "toxic"], "doc_id").select("doc_id", "split")


def stratified_split_orders(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate").cast("string"))
    return P.train_test_split(o, ["o_orderpriority", "day"], "o_orderkey", singletons="both").select("o_orderkey", "split")


SPLIT_SQL = """
select doc_id, case when rn <= round(0.25 * n) then 'test' else 'train' end split from (
  select doc_id, row_number() over (partition by quality, toxic order by md5('42:' || doc_id), doc_id) rn,
    count(*) over (partition by quality, toxic) n from labels)
"""
SPLIT_ORDERS_SQL = """
with r as (select o_orderkey, row_number() over w rn, count(*) over (partition by o_orderpriority, o_orderdate) n from orders
  window w as (partition by o_orderpriority, o_orderdate order by md5('42:' || o_orderkey), o_orderkey))
select o_orderkey, case when n > 1 and rn <= round(0.25 * n) then 'test' else 'train' end split from r
union all select o_orderkey, 'test' from r where n = 1
"""


def stratified_folds(spark, sf):
    return P.stratified_folds(table(spark, sf, "labels"), "quality", "doc_id", 5).select("doc_id", "fold")


def stratified_folds_lines(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("line"), "l_returnflag")
    return P.stratified_folds(li.groupBy("line").agg(F.max("l_returnflag").alias("flag")), "flag", "line", 3).select(
        F.md5("line").alias("line"), "fold")


def _folds_sql(src, key, label, k):
    return f"""select {key}, cast(floor((rn - 1) * {k} / n) as int) fold from (
  select {key}, row_number() over (partition by {label} order by md5('42:' || {key}), {key}) rn,
    count(*) over (partition by {label}) n from {src})"""


FOLDS_LINES_SQL = "select md5(line) as line, fold from (" + _folds_sql(
    "(select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as line, max(l_returnflag) flag from lineitem group by 1)",
    "line", "flag", 3) + ")"


def random_oversample(spark, sf):
    return B.random_oversample(table(spark, sf, "labels"), "quality", "doc_id").select("doc_id", "copy_no", "quality")


def random_oversample_lines(spark, sf):
    e = table(spark, sf, "events")
    return B.random_oversample(e, "event_type", "event_id").groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.sum((F.col("copy_no") > 0).cast("int")).alias("n_added"))


def _copies_sql(src, label, key):
    return f"""copies as (
  select *, (top - n) // n + case when rn <= (top - n) % n then 1 else 0 end as extra from (
    select *, max(n) over () top from (
      select *, row_number() over (partition by {label} order by md5('42:' || {key}), {key}) rn,
        count(*) over (partition by {label}) n from {src})))"""


OVERSAMPLE_SQL = f"""
with {_copies_sql('labels', 'quality', 'doc_id')}
select doc_id, copy_no, quality from (select doc_id, quality, unnest(range(0, extra + 1)) copy_no from copies)
"""
OVERSAMPLE_LINES_SQL = f"""
with {_copies_sql('events', 'event_type', 'event_id')}
select event_type, cast(sum(extra + 1) as bigint) n_rows, cast(sum(extra) as bigint) n_added from copies group by 1
"""

DOCS = "docs as (select doc_id, n_chars, length(text) as length, cast(doc_id % 3 as int) third, lang, quality, toxic from documents join labels using (doc_id))"


def nearest(spark, sf):
    near = nearest_in_group(labelled_docs(spark, sf), "doc_id", "quality", ["n_chars", "length", "third"], 5)
    n = near.select("doc_id", "quality", F.explode("neighbours").alias("n"))
    return n.select("doc_id", "quality", F.col("n.rank").alias("rank"), F.col("n.id").alias("neighbour"),
                    F.round("n.dist", 6).alias("dist"))


NEAREST_SQL = f"""
with {DOCS}
select doc_id, quality, cast(rank as int) as rank, neighbour, round(sqrt(d), 6) dist from (
  select a.doc_id, a.quality, b.doc_id neighbour,
    power(a.n_chars - b.n_chars, 2) + power(a.length - b.length, 2) + power(a.third - b.third, 2) d,
    row_number() over (partition by a.doc_id order by d, b.doc_id) as rank
  from docs a join docs b on a.quality = b.quality and a.doc_id <> b.doc_id) where rank <= 5
"""


def nearest_events(spark, sf):
    """Neighbours of every event among the events of its type, on two columns; summed up per type."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value", (F.col("user_id") % 50).alias("u"))
    near = nearest_in_group(e, "event_id", "event_type", ["value", "u"], 3, cell_rows=500)
    return near.groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.round(F.sum(F.aggregate(
            F.transform("neighbours", lambda n: n["dist"]), F.lit(0.0), lambda a, x: a + x)), 3).alias("total_dist"),
        F.sum(F.aggregate(F.transform("neighbours", lambda n: n["id"]), F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("id_sum"))


NEAREST_EVENTS_SQL = """
select event_type, count(distinct event_id) n_rows, round(sum(sqrt(d)), 3) total_dist, cast(sum(neighbour) as bigint) id_sum from (
  select a.event_id, a.event_type, b.event_id neighbour,
    power(a.value - b.value, 2) + power(a.user_id % 50 - b.user_id % 50, 2) d,
    row_number() over (partition by a.event_id order by d, b.event_id) rk
  from events a join events b on a.event_type = b.event_type and a.event_id <> b.event_id) where rk <= 3 group by 1
"""


def smote_rows(spark, sf):
    out = B.smote(labelled_docs(spark, sf), "quality", "doc_id", ["n_chars", "length", "third"])
    return out.select("doc_id", "copy_no", "neighbour_id", "quality",
                      *[F.round(c, 4).alias(c) for c in ("n_chars", "length", "third")])


_PICK = U01.format("'42-pick:' || a.doc_id || ':' || a.copy_no")
_GAP = U01.format("'42-gap:' || a.doc_id || ':' || a.copy_no")
SMOTE_SQL = f"""
with {DOCS}, {_copies_sql('docs', 'quality', 'doc_id')},
c as (select *, unnest(range(1, extra + 1)) copy_no from copies where extra > 0),
near as (select a.doc_id, b.doc_id nid, b.n_chars bn, b.length bl, b.third bt,
    row_number() over (partition by a.doc_id order by power(a.n_chars - b.n_chars, 2) + power(a.length - b.length, 2)
      + power(a.third - b.third, 2), b.doc_id) - 1 as rk
  from docs a join docs b on a.quality = b.quality and a.doc_id <> b.doc_id)
select a.doc_id, a.copy_no, n.nid neighbour_id, a.quality, round(a.n_chars + {_GAP} * (bn - a.n_chars), 4) n_chars,
  round(a.length + {_GAP} * (bl - a.length), 4) as length, round(a.third + {_GAP} * (bt - a.third), 4) third
from c a join near n on n.doc_id = a.doc_id and n.rk = cast(floor({_PICK} * 5) as bigint)
"""


def smote_nc_rows(spark, sf):
    out = B.smote_nc(labelled_docs(spark, sf), "quality", "doc_id", ["n_chars", "length"], ["lang", "third"])
    return out.select("doc_id", "copy_no", "neighbour_id", "quality",
                      *[F.round(c, 4).alias(c) for c in ("n_chars", "length")], "lang", "third")


SMOTE_NC_SQL = f"""
with {DOCS}, {_copies_sql('docs', 'quality', 'doc_id')},
sp as (select quality, (stddev_pop(n_chars) + stddev_pop(length)) / 2 as m from docs group by 1),
c as (select *, unnest(range(1, extra + 1)) copy_no from copies where extra > 0),
near as (select * from (select a.doc_id, b.doc_id nid, b.n_chars bn, b.length bl, b.lang blang, b.third bt,
    row_number() over (partition by a.doc_id order by power(a.n_chars - b.n_chars, 2) + power(a.length - b.length, 2)
      + m * m * cast(a.lang <> b.lang as int) + m * m * cast(a.third <> b.third as int), b.doc_id) - 1 as rk
  from docs a join docs b on a.quality = b.quality and a.doc_id <> b.doc_id join sp on sp.quality = a.quality) where rk < 5),
ml as (select doc_id, blang from (select doc_id, blang, row_number() over (partition by doc_id order by count(*) desc, blang) r from near group by 1, 2) where r = 1),
mt as (select doc_id, bt from (select doc_id, bt, row_number() over (partition by doc_id order by count(*) desc, bt) r from near group by 1, 2) where r = 1)
select a.doc_id, a.copy_no, n.nid neighbour_id, a.quality, round(a.n_chars + {_GAP} * (bn - a.n_chars), 4) n_chars,
  round(a.length + {_GAP} * (bl - a.length), 4) as length, ml.blang lang, mt.bt third
from c a join near n on n.doc_id = a.doc_id and n.rk = cast(floor({_PICK} * 5) as bigint)
join ml on ml.doc_id = a.doc_id join mt on mt.doc_id = a.doc_id
"""


def resampling_summary(spark, sf):
    before = table(spark, sf, "labels")
    after = B.random_oversample(before, "quality", "doc_id")
    return B.resampling_summary(before, after, "quality").withColumn("share_delta", F.round("share_delta", 6))


RESAMPLING_SQL = """
with c as (select quality, count(*) n_before from labels group by 1), t as (select max(n_before) top, sum(n_before) n, count(*) k from c)
select quality, n_before, top n_after, top - n_before n_added, round(1.0 / k - n_before / n, 6) share_delta from c, t
"""


# --- metrics ---------------------------------------------------------------------------------

def _predicted(spark, sf):
    e = table(spark, sf, "events")
    guess = F.expr("case when value < 3 then 'view' when value < 8 then 'click' when value < 14 then 'error' else event_type end")
    return e.withColumns({"guess": guess, "fold": (F.col("event_id") % 5).cast("int"), "model": F.expr("concat('m', user_id % 4)")})


PRED = """p as (select *, case when value < 3 then 'view' when value < 8 then 'click' when value < 14 then 'error' else event_type end guess,
  cast(event_id % 5 as int) fold, 'm' || (user_id % 4) model from events)"""


def _per_class_sql(by=""):
    b = f"{by}, " if by else ""
    j = " and ".join(f"s.{x.strip()} = q.{x.strip()}" for x in by.split(",")) + " and " if by else ""
    keys = "".join(f"coalesce(s.{x.strip()}, q.{x.strip()}) {x.strip()}, " for x in by.split(",")) if by else ""
    return f"""s as (select {b}event_type c, count(*) support, sum(cast(event_type = guess as int)) hits from p group by {b}event_type),
q as (select {b}guess c, count(*) predicted from p group by {b}guess),
m as (select {keys}coalesce(s.c, q.c) c, coalesce(support, 0) support, coalesce(hits, 0) hits, coalesce(predicted, 0) predicted,
  coalesce(hits / nullif(predicted, 0), 0) prec, coalesce(hits / nullif(support, 0), 0) rec,
  coalesce(2 * hits / (coalesce(predicted, 0) + coalesce(support, 0)), 0) f1 from s full join q on {j}s.c = q.c)"""


def classification_report(spark, sf):
    r = M.classification_report(_predicted(spark, sf), "event_type", "guess")
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


REPORT_SQL = f"""
with {PRED}, {_per_class_sql()},
a as (select sum(hits) / sum(support) acc, avg(prec) p, avg(rec) r, avg(f1) f, sum(prec * support) / sum(support) wp,
  sum(rec * support) / sum(support) wr, sum(f1 * support) / sum(support) wf, cast(sum(support) as bigint) n from m)
select c as class, round(prec, 6) as precision, round(rec, 6) recall, round(f1, 6) f1, support from m
union all select 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n from a
union all select 'macro avg', round(p, 6), round(r, 6), round(f, 6), n from a
union all select 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n from a
"""


def confusion(spark, sf):
    return M.confusion(_predicted(spark, sf), "event_type", "guess")


def macro_f1(spark, sf):
    out = M.averaged_metrics(_predicted(spark, sf), "event_type", "guess", ["model", "fold"])
    return out.select("model", "fold", F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


MACRO_SQL = f"""
with {PRED}, {_per_class_sql('model, fold')}
select model, fold, round(avg(f1), 6) macro_f1, round(sum(hits) / sum(support), 6) accuracy from m group by model, fold
"""


def roc_auc(spark, sf):
    out = M.roc_auc(labelled_docs(spark, sf), "quality", "n_chars")
    return out.withColumn("auc", F.round("auc", 6))


AUC_SQL = f"""
with {DOCS}, r as (select quality, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 rk from docs)
select round((sum(rk) filter (quality = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) auc, n1 n_pos, n0 n_neg from r,
  (select sum(quality)::bigint n1, sum(1 - quality)::bigint n0 from docs) group by n1, n0
"""


def roc_auc_lines(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return M.roc_auc(li, "y", "l_extendedprice").withColumn("auc", F.round("auc", 6))


AUC_LINES_SQL = """
with d as (select cast(l_returnflag = 'R' as int) y, l_extendedprice x from lineitem),
r as (select y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rk from d)
select round((sum(rk) filter (y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) auc, n1 n_pos, n0 n_neg from r,
  (select sum(y)::bigint n1, sum(1 - y)::bigint n0 from d) group by n1, n0
"""


def _scored_lines(spark, sf):
    a, b = F.col("l_discount") * 4 + 0.1, F.col("l_quantity") / 125
    rest = F.lit(1.0) - a - b
    return table(spark, sf, "lineitem").select(
        F.expr("case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end").alias("y"), F.array(a, b, rest).alias("p"))


def roc_auc_multiclass(spark, sf):
    return M.roc_auc_ovo(_scored_lines(spark, sf), "y", "p", [0, 1, 2]).select(F.round("auc", 6).alias("auc"))


MULTI = """d as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end y,
  [l_discount * 4 + 0.1, l_quantity / 125, 1.0 - (l_discount * 4 + 0.1) - l_quantity / 125] p from lineitem)"""
AUC_MULTI_SQL = f"""
with {MULTI}, pr as (select a.v a, b.v b from (values (0), (1), (2)) a(v), (values (0), (1), (2)) b(v) where a.v <> b.v),
r as (select a, b, cast(y = a as int) pos, rank() over (partition by a, b order by p[a + 1])
   + (count(*) over (partition by a, b, p[a + 1]) - 1) / 2.0 rk from d join pr on y = a or y = b),
g as (select a, b, sum(pos) n1, sum(1 - pos) n0, (sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(1 - pos)) auc from r group by a, b)
select round(sum(auc * (n1 + n0)) / sum(n1 + n0), 6) auc from g
"""


def log_loss(spark, sf):
    return M.log_loss(_scored_lines(spark, sf), "y", "p").withColumn("log_loss", F.round("log_loss", 6))


LOG_LOSS_SQL = f"""
with {MULTI} select round(-avg(ln(least(greatest(p[y + 1], 1e-15), 1 - 1e-15))), 6) log_loss, count(*) n_rows from d
"""


def majority_label(spark, sf):
    o = table(spark, sf, "orders").withColumn("cls", F.substring("o_orderpriority", 1, 1).cast("int"))
    return M.majority_label(o, "cls")


def _fold_scores(spark, sf):
    return M.averaged_metrics(_predicted(spark, sf), "event_type", "guess", ["model", "fold"])


FOLD_SCORES = f"""{PRED}, {_per_class_sql('model, fold')},
fs as (select model, fold, avg(prec) macro_precision, avg(rec) macro_recall, avg(f1) macro_f1, sum(hits) / sum(support) accuracy from m group by 1, 2)"""


def cv_summary(spark, sf):
    out = M.cv_summary(_fold_scores(spark, sf).withColumnRenamed("macro_f1", "score"), ["model"])
    return out.select("model", "n_folds", F.round("mean_score", 6).alias("mean_score"), F.round("std_score", 6).alias("std_score"))


CV_SQL = f"with {FOLD_SCORES} select model, count(*) n_folds, round(avg(macro_f1), 6) mean_score, round(stddev_pop(macro_f1), 6) std_score from fs group by 1"


def worst_fold(spark, sf):
    out = M.worst_fold(_fold_scores(spark, sf), ["model"])
    return out.select("model", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("worst_") and c != "worst_fold"], "worst_fold")


WORST_SQL = f"""with {FOLD_SCORES} select model, round(min(macro_precision), 6) worst_macro_precision, round(min(macro_recall), 6) worst_macro_recall,
 round(min(macro_f1), 6) worst_macro_f1, round(min(accuracy), 6) worst_accuracy, arg_min(fold, macro_f1) worst_fold from fs group by 1"""


# --- candidate tables: one "candidate" per part, scored by its sales ---------------------------

def _candidates(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_discount").alias("mean_f1"))
    p = table(spark, sf, "part")
    score = F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).otherwise(F.round("mean_f1", 6))
    return p.join(li, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("model"), score.alias("mean_f1"))


CAND = """cand as (select p_partkey ordinal, p_brand model, case when p_size % 7 = 0 then null else round(mean_f1, 6) end mean_f1
  from part left join (select l_partkey, avg(l_discount) mean_f1 from lineitem group by 1) on l_partkey = p_partkey)"""


def top_candidates(spark, sf):
    return C.top_candidates(_candidates(spark, sf), 10)


def best_candidate(spark, sf):
    return C.best_candidate(_candidates(spark, sf), ["model"])


def candidate_limit(spark, sf):
    return C.limit_per_model(_candidates(spark, sf), 3).select("model", "ordinal")


def until_target(spark, sf):
    return C.until_target(_candidates(spark, sf), 0.0599).select("ordinal")


def run_history(spark, sf):
    return C.valid_counts(_candidates(spark, sf))


TOP_SQL = f"with {CAND} select ordinal, model, mean_f1 from cand order by mean_f1 desc nulls last, ordinal limit 10"
BEST_SQL = f"""with {CAND} select model, ordinal, mean_f1 from (select *, row_number() over (partition by model order by mean_f1 desc, ordinal) r
  from cand where mean_f1 is not null) where r = 1"""
LIMIT_SQL = f"with {CAND} select model, ordinal from (select *, row_number() over (partition by model order by ordinal) r from cand) where r <= 3"
UNTIL_SQL = f"with {CAND} select ordinal from cand where ordinal <= coalesce((select min(ordinal) from cand where mean_f1 >= 0.0599), 9223372036854775807)"
HISTORY_SQL = f"with {CAND} select model, count(*) n_candidates, count(mean_f1) n_valid, max(mean_f1) best_score from cand group by 1"


def search_ledger(spark, sf):
    """A search that stops at its target, is flushed twice, restarted, and whose failures are tried again."""
    found = settle(_candidates(spark, sf).withColumns({
        "params": F.format_string('{"part": %d}', "ordinal"), L.KEY: L.candidate_key("parts", "model", "ordinal")}))
    second = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("ordinal")).agg(F.round(F.avg("l_discount"), 6).alias("_score"))
    plan = found.select("ordinal", "model", "params", L.KEY)
    path = scratch(spark, "ledger")

    def rows(of, attempt):
        return of.select(L.KEY, "ordinal", "model", "params", "mean_f1", F.lit(attempt).alias("attempt"), F.lit(float(attempt)).alias("timestamp"))

    first = rows(C.until_target(found, 0.0599), 1)
    L.commit(first, path)
    L.commit(first, path)
    L.commit(rows(L.unfinished(found, spark.read.parquet(path)), 2), path)
    failed = L.unfinished(plan, spark.read.parquet(path), retry_failed=True)
    L.commit(rows(failed.join(second, "ordinal", "left").withColumnRenamed("_score", "mean_f1"), 3), path)
    return L.planned_results(plan, spark.read.parquet(path)).select("ordinal", "model", F.nanvl("mean_f1", F.lit(None)).alias("mean_f1"), "attempt")


def search_history(spark, sf):
    """The history entry of a run, a row for each of its best candidates."""
    named = _candidates(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), "p_type"), "ordinal")
    entry = C.history_entry(named.withColumn("model", F.concat_ws(" ", "model", "p_type")), "run", n=20)
    return entry.select("n_candidates", "n_valid", F.concat_ws(",", "models_present").alias("models_present"),
                        F.concat_ws(",", "models_without_valid").alias("models_without_valid"), F.inline("top"))


LEDGER_SQL = f"""with {CAND}, second as (select l_partkey ordinal, round(avg(l_discount), 6) again from lineitem group by 1),
 stop as (select coalesce(min(ordinal), 9223372036854775807) s from cand where mean_f1 >= 0.0599)
 select ordinal, model, coalesce(mean_f1, again) mean_f1, case when mean_f1 is null and again is not null then 3 when ordinal <= s then 1 else 2 end::int attempt
 from cand left join second using (ordinal), stop"""
SEARCH_HISTORY_SQL = f"""with {CAND}, named as (select ordinal, model || ' ' || p_type as model, mean_f1 from cand join part on p_partkey = ordinal),
 per as (select model, count(*) n, count(mean_f1) v from named group by 1),
 head as (select sum(n)::bigint n_candidates, sum(v)::bigint n_valid, string_agg(model, ',' order by model) models_present,
  coalesce(string_agg(model, ',' order by model) filter (v = 0), '') models_without_valid from per)
 select head.*, row_number() over (order by mean_f1 desc, ordinal)::int place, ordinal, model, mean_f1
 from (select * from named where mean_f1 is not null order by mean_f1 desc, ordinal limit 20), head"""


# --- feature scores ----------------------------------------------------------------------------
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_UNP = "unpivot (select l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::double l_linenumber from lineitem) on " + ", ".join(FEATURES) + " into name feature value v"


def _scores(fn):
    def run(spark, sf):
        return fn(table(spark, sf, "lineitem"), "l_returnflag", FEATURES).withColumn("score", F.round("score", 4))
    return run


CHI2 = f"""u as ({_UNP}), o as (select feature, l_returnflag c, sum(v) s, count(*) n from u group by 1, 2),
t as (select feature, sum(s) fs, sum(n) fn from o group by 1),
chi as (select feature, sum(power(s - n / fn * fs, 2) / (n / fn * fs)) score from o join t using (feature) group by 1)"""
CHI2_SQL = f"with {CHI2} select feature, round(score, 4) score from chi"
ANOVA_SQL = f"""with u as ({_UNP}), o as (select feature, l_returnflag c, sum(v) s, sum(v * v) q, count(*) n from u group by 1, 2),
g as (select feature, count(*) k, sum(n) n, sum(s) t, sum(q) q, sum(s * s / n) b from o group by 1)
select feature, round(((b - t * t / n) / (k - 1)) / ((q - b) / (n - k)), 4) score from g"""
MI_SQL = f"""with u as ({_UNP}), r as (select feature, min(v) lo, max(v) hi from u group by 1),
b as (select feature, l_returnflag c, least(floor((v - lo) / (hi - lo) * 10), 9) bin from u join r using (feature)),
j as (select feature, c, bin, count(*) n from b group by 1, 2, 3),
nb as (select feature, bin, sum(n) nb from j group by 1, 2), nc as (select feature, c, sum(n) nc from j group by 1, 2), nt as (select feature, sum(n) nt from j group by 1)
select feature, round(sum(n / nt * ln(n * nt / (nb * nc))), 4) score from j join nb using (feature, bin) join nc using (feature, c) join nt using (feature) group by 1"""


def mutual_info_neighbours(spark, sf):
    """Amounts in whole cents and percents, so that distances are exact in both engines."""
    whole = table(spark, sf, "lineitem").withColumns({f: F.round(F.col(f) * 100) for f in FEATURES})
    return neighbour_mutual_info_scores(whole, "l_returnflag", FEATURES).withColumn("score", F.round("score", 6))


_STEPS = [f"{side}(v, {i}) over (partition by feature, c order by v)" for side in ("lag", "lead") for i in (1, 2, 3)]
MI_NEIGHBOURS_SQL = f"""with u as (select feature, l_returnflag c, round(v * 100) v from ({_UNP})),
s as (select feature, c, count(*) nc from u group by 1, 2 having count(*) > 1), o as (select u.*, nc from u join s using (feature, c)),
d as (select feature, c, v, nc, [{", ".join(f"abs(v - {x})" for x in _STEPS)}] ds from o),
r as (select feature, c, v, nc, list_sort([x for x in ds if x is not null])[least(3, nc - 1)] r from d),
q as (select feature, c, v, nc, min(r) r, count(*) w from r group by 1, 2, 3, 4), p as (select feature, v, count(*) n from o group by 1, 2),
m as (select q.feature, q.c, q.v, q.nc, q.w, sum(p.n)::bigint m from q join p on p.feature = q.feature and p.v > q.v - q.r and p.v < q.v + q.r where q.r > 0 group by 1, 2, 3, 4, 5
  union all select q.feature, q.c, q.v, q.nc, q.w, p.n from q join p on p.feature = q.feature and p.v = q.v where q.r = 0),
h as (select i, coalesce(sum(1.0::double / i) over (order by i rows between unbounded preceding and 1 preceding), 0) - 0.5772156649015329 psi from range(1, (select count(*) + 1 from lineitem)) x(i)),
t as (select feature, sum(w)::bigint n, sum(w * (hk.psi - hc.psi - hm.psi)) s from m join h hk on hk.i = least(3, nc - 1) join h hc on hc.i = nc join h hm on hm.i = m group by 1)
select feature, round(greatest(0, h.psi + s / n), 6) score from t join h on h.i = n"""


def top_k_features(spark, sf):
    return S.top_k(S.chi2_scores(table(spark, sf, "lineitem"), "l_returnflag", FEATURES), 3).select("feature")


# --- quality -----------------------------------------------------------------------------------

def _dirty(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_quantity", F.when(F.col("l_tax") == 0, None).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_discount") == 0.1, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("l_discount"),
        (F.col("l_linenumber") % 3).alias("flag"), (F.col("l_extendedprice") * 2 + 1).alias("twice"), "l_extendedprice")


DIRTY = """dirty as (select l_orderkey, l_quantity, case when l_tax = 0 then null else l_tax end l_tax,
  case when l_discount = 0.1 then 'inf'::double else l_discount end l_discount, l_linenumber % 3 flag, l_extendedprice * 2 + 1 twice, l_extendedprice from lineitem)"""
_DIRTY_COLS = ["l_orderkey", "l_quantity", "l_tax", "l_discount", "flag", "twice", "l_extendedprice"]


def dq_profile(spark, sf):
    return Q.column_profile(_dirty(spark, sf))


DQ_PROFILE_SQL = f"with {DIRTY} " + " union all ".join(
    f"select '{c}' as \"column\", count(*) n_rows, count(*) - count({c}) n_null, count(*) filter (isinf({c}::double)) n_inf from dirty" for c in _DIRTY_COLS)


def dq_validate(spark, sf):
    r = Q.validate_frame(_dirty(spark, sf), "SMOTE", categorical=["flag", "l_quantity", "gone"], ohe=["flag", "absent"])
    return r.select("check", "severity", "column", "metric")


DQ_VALIDATE_SQL = f"""with {DIRTY}
select 'null' as "check", 'error' severity, 'l_tax' as "column", count(*)::double metric from dirty where l_tax is null
union all select 'infinite', 'error', 'l_discount', count(*)::double from dirty where isinf(l_discount)
union all select 'non_binary', 'issue', 'flag', count(*)::double from dirty where flag not in (0, 1)
union all select 'missing_categorical', 'error', 'gone', null union all select 'missing_one_hot', 'error', 'absent', null
union all select 'categorical_type', 'warning', 'l_quantity', null
"""


def dq_compare(spark, sf):
    before = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_discount", "l_linenumber", "l_extendedprice")
    after = _dirty(spark, sf).withColumn("l_orderkey", F.col("l_orderkey").cast("double")).withColumn(
        "l_quantity", F.col("l_quantity").cast("int")).drop("l_discount").withColumn("l_discount", F.when(F.col("flag") == 2, None).otherwise(F.col("l_tax")))
    r = Q.compare_frames(before, after)
    return r.select("check", "severity", "column", F.round("metric", 4).alias("metric"))


DQ_COMPARE_SQL = f"""with {DIRTY}
select 'column_added' as "check", 'info' severity, 'flag' as "column", null::double metric union all select 'column_added', 'info', 'twice', null
union all select 'column_removed', 'info', 'l_linenumber', null
union all select 'type_change', 'error', 'l_orderkey', null union all select 'type_change', 'warning', 'l_quantity', null
union all select 'new_bad_values', 'error', 'l_tax', count(*)::double from dirty where l_tax is null
union all select 'new_bad_values', 'error', 'l_discount', count(*)::double from dirty where l_tax is null or flag = 2
"""


def dq_model_input(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.when(F.col("o_orderkey") == 3, 99).otherwise(F.col("o_orderkey") % 3))
    return Q.validate_model_input(o, "y", ["o_custkey", "o_totalprice"]).select("check", "severity", "column", "metric")


def high_corr_pairs(spark, sf):
    out = Q.pair_correlations(_dirty(spark, sf).drop("l_discount"), ["l_quantity", "l_tax", "twice", "l_extendedprice"], 0.95)
    return out.withColumn("correlation", F.round("correlation", 6))


def pair_correlations(spark, sf):
    out = Q.pair_correlations(table(spark, sf, "lineitem"), FEATURES)
    return out.withColumn("correlation", F.round("correlation", 6))


CORR_SQL = " union all ".join(
    f"select '{a}' column_a, '{b}' column_b, round(corr({a}, {b}), 6) correlation from lineitem"
    for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:])


WIDE = 40


def wide_correlations(spark, sf):
    """All pairs of many columns in one pass: remainders of multiples of the part key."""
    li = table(spark, sf, "lineitem").select(*[F.pmod(F.col("l_partkey") * k, F.lit(101)).alias(f"c{k}") for k in range(1, WIDE + 1)])
    return Q.pair_correlations(li, li.columns).withColumn("correlation", F.round("correlation", 6))


WIDE_SQL = f"""with x as (select [(l_partkey * k) % 101 for k in range(1, {WIDE + 1})] as x from lineitem)
select 'c' || i as column_a, 'c' || j as column_b, round(corr(x[i], x[j]), 6) as correlation
from x, unnest(range(1, {WIDE + 1})) as t(i), unnest(range(1, {WIDE + 1})) as u(j) where i < j group by i, j"""


def numeric_summary(spark, sf):
    out = Q.numeric_summary(table(spark, sf, "lineitem"), FEATURES[:3])
    return out.select("column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


SUMMARY_SQL = " union all ".join(
    f"select '{c}' as \"column\", count({c}) n, round(avg({c}), 4) mean, round(stddev_samp({c}), 4) std, min({c}) as min, "
    f"round(quantile_cont({c}, 0.25), 4) q25, round(quantile_cont({c}, 0.5), 4) q50, round(quantile_cont({c}, 0.75), 4) q75, max({c}) as max from lineitem" for c in FEATURES[:3])


def sample_values(spark, sf):
    return Q.sample_values(table(spark, sf, "lineitem"), "l_quantity")


def as_integers(spark, sf):
    return Q.to_integers(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"),
                         ["l_quantity", "l_extendedprice"])


def ensemble_average(spark, sf):
    p = _scored_lines(spark, sf).withColumn("q", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)))
    out = average_probabilities(p, ["p", "q"])
    return out.groupBy("prediction").agg(F.count("*").alias("n_rows"), F.round(F.sum(F.get("probability", 1)), 3).alias("p1"))


ENSEMBLE_SQL = f"""with {MULTI}, a as (select [(p[1] + 0.5) / 2, (p[2] + 0.25) / 2, (p[3] + 0.25) / 2] p from d)
select case when p[1] >= p[2] and p[1] >= p[3] then 0 when p[2] >= p[3] then 1 else 2 end prediction, count(*) n_rows, round(sum(p[2]), 3) p1 from a group by 1"""


QUERIES = {
    "class_balance": (class_balance, "select event_type, count(*) n_rows, count(*) < 5 too_small from events group by 1"),
    "minority_share": (minority_share, "select count(*) n_classes, sum(k)::bigint n_rows, min(k) min_rows, max(k) max_rows, round(min(k) / sum(k), 6) minority_share from (select count(*) k from labels group by quality)"),
    "class_weights": (class_weights, "select doc_id, round((select count(*) from labels) / ((select count(distinct quality) from labels) * count(*) over (partition by quality)), 6) weight from labels"),
    "stratum_counts": (stratum_counts, "select quality || '_' || toxic stratum, count(*) n_rows from labels group by 1"),
    "rare_strata": (rare_strata, "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority from orders qualify count(*) over (partition by day, o_orderpriority) < 2"),
    "stratified_split": (stratified_split, SPLIT_SQL),
    "stratified_split_singletons": (stratified_split_orders, SPLIT_ORDERS_SQL),
    "stratified_folds": (stratified_folds, _folds_sql("labels", "doc_id", "quality", 5)),
    "stratified_folds_lines": (stratified_folds_lines, FOLDS_LINES_SQL),
    "random_oversample": (random_oversample, OVERSAMPLE_SQL),
    "random_oversample_events": (random_oversample_lines, OVERSAMPLE_LINES_SQL),
    "nearest_in_class": (nearest, NEAREST_SQL),
    "nearest_in_class_events": (nearest_events, NEAREST_EVENTS_SQL),
    "smote_rows": (smote_rows, SMOTE_SQL),
    "smote_nc_rows": (smote_nc_rows, SMOTE_NC_SQL),
    "resampling_summary": (resampling_summary, RESAMPLING_SQL),
    "classification_report": (classification_report, REPORT_SQL),
    "confusion": (confusion, f"with {PRED} select event_type y_true, guess y_pred, count(*) n_rows from p group by 1, 2"),
    "macro_f1": (macro_f1, MACRO_SQL),
    "roc_auc": (roc_auc, AUC_SQL),
    "roc_auc_lines": (roc_auc_lines, AUC_LINES_SQL),
    "roc_auc_multiclass": (roc_auc_multiclass, AUC_MULTI_SQL),
    "log_loss": (log_loss, LOG_LOSS_SQL),
    "majority_label": (majority_label, "select cast(substring(o_orderpriority, 1, 1) as int) as cls from orders group by 1 order by count(*) desc, 1 limit 1"),
    "cv_summary": (cv_summary, CV_SQL),
    "worst_fold": (worst_fold, WORST_SQL),
    "top_candidates": (top_candidates, TOP_SQL),
    "best_candidate": (best_candidate, BEST_SQL),
    "candidate_limit": (candidate_limit, LIMIT_SQL),
    "until_target": (until_target, UNTIL_SQL),
    "run_history": (run_history, HISTORY_SQL),
    "search_ledger": (search_ledger, LEDGER_SQL),
    "search_history": (search_history, SEARCH_HISTORY_SQL),
    "chi2_scores": (_scores(S.chi2_scores), CHI2_SQL),
    "anova_f": (_scores(S.anova_f_scores), ANOVA_SQL),
    "mutual_info": (_scores(S.mutual_info_scores), MI_SQL),
    "mutual_info_neighbours": (mutual_info_neighbours, MI_NEIGHBOURS_SQL),
    "top_k_features": (top_k_features, f"with {CHI2} select feature from chi order by score desc, feature limit 3"),
    "dq_profile": (dq_profile, DQ_PROFILE_SQL),
    "dq_validate": (dq_validate, DQ_VALIDATE_SQL),
    "dq_compare": (dq_compare, DQ_COMPARE_SQL),
    "dq_model_input": (dq_model_input, "select 'small_class' as \"check\", 'issue' severity, 'y' as \"column\", 1.0::double metric from orders where o_orderkey = 3"),
    "high_corr_pairs": (high_corr_pairs, "select 'twice' column_a, 'l_extendedprice' column_b, round(corr(l_extendedprice * 2 + 1, l_extendedprice), 6) correlation from lineitem"),
    "pair_correlations": (pair_correlations, CORR_SQL),
    "wide_correlations": (wide_correlations, WIDE_SQL),
    "numeric_summary": (numeric_summary, SUMMARY_SQL),
    "sample_values": (sample_values, "select distinct l_quantity from lineitem order by 1 limit 20"),
    "as_integers": (as_integers, "select l_orderkey, l_partkey, l_suppkey, trunc(l_quantity)::int l_quantity, trunc(l_extendedprice)::int l_extendedprice from lineitem"),
    "ensemble_average": (ensemble_average, ENSEMBLE_SQL),
}
