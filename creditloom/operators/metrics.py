"""Classification metrics over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditloom.operators.scans import prefix_scan, range_chunks


def confusion(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (true, predicted) class."""
    return df.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count("*").alias("n_rows")
    )


def per_class_metrics(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; only the confusion counts are regrouped."""
    cells = confusion(df, y_true, y_pred, by)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n_rows")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y_true").alias("c"), F.col("n_rows").alias("s"), F.lit(0).cast("bigint").alias("p"), hit.alias("t")),
        F.struct(F.col("y_pred").alias("c"), F.lit(0).cast("bigint").alias("s"), F.col("n_rows").alias("p"), F.lit(0).cast("bigint").alias("t")),
    )
    sums = (
        cells.select(*by, F.explode(sides).alias("_x"))
        .groupBy(*by, F.col("_x.c").alias("class"))
        .agg(F.sum("_x.s").alias("support"), F.sum("_x.p").alias("predicted"), F.sum("_x.t").alias("hits"))
    )
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return sums.select(
        *by, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        "support", "predicted", "hits",
    )


def averaged_metrics(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by``): accuracy and the macro and weighted averages."""
    m = per_class_metrics(df, y_true, y_pred, by)
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return m.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"), weighted("f1").alias("weighted_f1"),
        F.sum("support").alias("support"),
    )


def classification_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Long report: one row per class, then accuracy, macro avg and weighted avg.

    The averages come from a rollup of the class rows, so the predictions are read once.
    """
    m = per_class_metrics(df, y_true, y_pred)
    sup = F.sum("support")
    wavg = lambda c: F.sum(F.col(c) * F.col("support")) / sup
    rolled = m.rollup("class").agg(
        F.grouping("class").alias("_all"),
        F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f1").alias("f"),
        wavg("precision").alias("wp"), wavg("recall").alias("wr"), wavg("f1").alias("wf"),
        (F.sum("hits") / sup).alias("acc"), sup.alias("support"),
    )

    def row(name, p, r, f):
        return F.struct(name.alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        F.col("support"))

    c = F.col
    total = F.array(
        row(F.lit("accuracy"), c("acc"), c("acc"), c("acc")),
        row(F.lit("macro avg"), c("p"), c("r"), c("f")),
        row(F.lit("weighted avg"), c("wp"), c("wr"), c("wf")),
    )
    single = F.array(row(c("class").cast("string"), c("p"), c("r"), c("f")))
    return rolled.select(F.explode(F.when(c("_all") == 1, total).otherwise(single)).alias("x")).select("x.*")


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Area under the ROC curve with average ranks on ties; one row.

    Rows are first counted per distinct score, which removes hot scores; the running count of
    negatives is then a chunked scan over the distinct scores.
    """
    pos = F.when(F.col(label) == F.lit(positive), 1).otherwise(0)
    per_score = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(score).alias("s")
    ).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    ordered = range_chunks(per_score, ["s"])
    run = prefix_scan(ordered, [], "_chunk", ["s"], {"neg_before": ("sum", F.col("neg"), False)})
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    return run.agg(
        F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )


def roc_auc_ovo(df: DataFrame, label: str, prob: str, classes: Sequence) -> DataFrame:
    """Multiclass AUC, one class against another, weighted by how common the two are.

    ``prob`` is an array with one probability per class. Every ordered pair (a, b) of classes
    is a key; a row of class a takes part in the pairs with the other classes only.
    """
    k = len(classes)
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    pairs = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda o: F.when(o == F.col("_i"), F.array().cast("array<struct<a:int,b:int,pos:int>>")).otherwise(F.array(
            F.struct(F.col("_i").alias("a"), o.alias("b"), F.lit(1).alias("pos")),
            F.struct(o.alias("a"), F.col("_i").alias("b"), F.lit(0).alias("pos")),
        )),
    )))
    rows = (
        df.select(idx.cast("int").alias("_i"), F.col(prob).alias("_p"))
        .withColumn("_x", pairs)
        .select(F.col("_x.a").alias("a"), F.col("_x.b").alias("b"), F.get("_p", F.col("_x.a")).alias("s"),
                F.col("_x.pos").alias("pos"))
    )
    per_score = rows.groupBy("a", "b", "s").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    ordered = range_chunks(per_score, ["a", "b", "s"])
    run = prefix_scan(ordered, ["a", "b"], "_chunk", ["s"], {"neg_before": ("sum", F.col("neg"), False)})
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    auc = run.groupBy("a", "b").agg(
        F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"),
        (F.sum("pos") + F.sum("neg")).alias("n"),
    )
    return auc.agg((F.sum(F.col("auc") * F.col("n")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("n")))).alias("auc"))


def log_loss(df: DataFrame, label: str, prob: str, eps: float = 1e-15) -> DataFrame:
    """Mean negative log of the true class's probability; ``prob`` is an array by class id."""
    p = F.get(F.col(prob), F.col(label).cast("int"))
    bounded = F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(F.log(bounded))).alias("log_loss"), F.count("*").alias("n_rows"))


def cv_summary(folds: DataFrame, by: Sequence[str], score: str = "score",
               fit_time: str | None = None, score_time: str | None = None) -> DataFrame:
    """Mean and population standard deviation over folds, with optional mean times."""
    aggs = [F.count(score).alias("n_folds"), F.avg(score).alias("mean_score"),
            F.stddev_pop(score).alias("std_score")]
    if fit_time:
        aggs.append(F.avg(fit_time).alias("mean_fit_time"))
    if score_time:
        aggs.append(F.avg(score_time).alias("mean_score_time"))
    return folds.groupBy(*by).agg(*aggs)


def worst_fold(fold_metrics: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """Per model: the worst value of each metric over folds, and the fold with the lowest F1."""
    return fold_metrics.groupBy(*by).agg(
        F.min("macro_precision").alias("worst_macro_precision"),
        F.min("macro_recall").alias("worst_macro_recall"),
        F.min("macro_f1").alias("worst_macro_f1"),
        F.min("accuracy").alias("worst_accuracy"),
        F.min_by(fold, F.struct("macro_f1", fold)).alias("worst_fold"),
    )


def single_class(df: DataFrame, label: str) -> bool:
    """Whether the target has fewer than two classes, so only a constant model makes sense."""
    return len(df.where(F.col(label).isNotNull()).select(label).distinct().limit(2).collect()) < 2


def majority_label(df: DataFrame, label: str) -> DataFrame:
    """The most frequent class, ties going to the smallest."""
    counts = df.groupBy(label).agg(F.count("*").alias("_k"))
    return counts.agg(F.max_by(label, F.struct("_k", (-F.col(label)).alias("_o"))).alias(label))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """Row number within ``by``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
