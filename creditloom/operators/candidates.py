"""Candidate tables of a model search: drawing, ranking, stopping and history."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_FEATURES = "feature_selecting_classifier__max_features"
THRESHOLD = "feature_selecting_classifier__threshold"


def _values(v) -> list:
    return list(v) if isinstance(v, Iterable) and not isinstance(v, (str, bytes, dict)) else [v]


def search_size(space: dict) -> int:
    """Sum of the value-list lengths; a single value counts as one."""
    if not space:
        raise ValueError("the parameter space is empty")
    return sum(len(_values(v)) for v in space.values())


def planned_candidates(space: dict, multiplier: float) -> int:
    return math.ceil(search_size(space) * multiplier)


def grid(space: dict) -> list[dict]:
    """Every combination of the value lists."""
    names = sorted(space)
    return [dict(zip(names, combo)) for combo in itertools.product(*[_values(space[n]) for n in names])]


def _draw(space: dict, n: int, rng: random.Random) -> list[dict]:
    """n distinct combinations in random order, or all of them when there are fewer."""
    names = sorted(space)
    lists = [_values(space[k]) for k in names]
    total = math.prod(len(x) for x in lists)
    picks = rng.sample(range(total), min(n, total))
    out = []
    for p in picks:
        row = {}
        for name, values in zip(names, lists):
            p, i = divmod(p, len(values))
            row[name] = values[i]
        out.append(row)
    return out


def sample_candidates(space: dict, n: int, seed: int = 42) -> list[dict]:
    """Draw n candidates: half set max_features, half set a threshold, never both."""
    half = math.ceil(n / 2)
    rng = random.Random(seed)
    drawn = _draw({**space, THRESHOLD: [None]}, half, rng) + _draw({**space, MAX_FEATURES: [None]}, half, rng)
    rng.shuffle(drawn)
    return drawn[:n]


def candidate_table(spark: SparkSession, candidates: dict[str, Sequence[dict]]) -> DataFrame:
    """(ordinal, model, params) with the parameters as JSON text."""
    rows, i = [], 0
    for model, params in candidates.items():
        for p in params:
            rows.append((i, model, json.dumps(p, sort_keys=True, default=str)))
            i += 1
    return spark.createDataFrame(rows, "ordinal bigint, model string, params string")


def _valid(score: str):
    return F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))


def top_candidates(df: DataFrame, n: int, score: str = "mean_f1", ordinal: str = "ordinal") -> DataFrame:
    """The n best candidates; failed ones come last, ties in search order."""
    return df.withColumn(score, _valid(score)).orderBy(F.desc_nulls_last(score), ordinal).limit(n)


def best_candidate(df: DataFrame, by: Sequence[str] = (), score: str = "mean_f1", ordinal: str = "ordinal") -> DataFrame:
    """The best candidate (per ``by``); an equal later score does not replace an earlier one."""
    valid = df.withColumn(score, _valid(score)).where(F.col(score).isNotNull())
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(ordinal)).alias("o")))
    return valid.groupBy(*by).agg(best.alias("x")).select(*by, "x.*").where(F.col(score).isNotNull())


def limit_per_model(df: DataFrame, n: int, model: str = "model", ordinal: str = "ordinal") -> DataFrame:
    """The first n candidates of every model."""
    w = W.partitionBy(model).orderBy(ordinal)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def until_target(df: DataFrame, target: float, score: str = "mean_f1", ordinal: str = "ordinal") -> DataFrame:
    """Candidates up to and including the first that reaches the target."""
    stop = df.agg(F.min(F.when(_valid(score) >= target, F.col(ordinal)))).first()[0]
    return df if stop is None else df.where(F.col(ordinal) <= stop)


def valid_counts(df: DataFrame, score: str = "mean_f1", model: str = "model") -> DataFrame:
    """Per model: candidates, those with a score, and the best score (null when none has one)."""
    v = _valid(score)
    return df.groupBy(model).agg(F.count("*").alias("n_candidates"), F.count(v).alias("n_valid"), F.max(v).alias("best_score"))


def history_entry(results: DataFrame, run_ts: str, args: str = "{}", n: int = 5, score: str = "mean_f1") -> DataFrame:
    """One row for the run history: how many candidates there were and how many have a score, the models
    present and those without a valid candidate (both by name), counts per model, and the ``n`` best
    candidates with their place. Failed candidates are never among the best; a run without rows gets
    empty lists."""
    per_model = F.struct("model", "n_candidates", "n_valid", "best_score")
    counts = valid_counts(results, score).agg(
        F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("n_candidates"), F.coalesce(F.sum("n_valid"), F.lit(0)).alias("n_valid"),
        F.array_sort(F.collect_list("model")).alias("models_present"),
        F.array_sort(F.collect_list(F.when(F.col("n_valid") == 0, F.col("model")))).alias("models_without_valid"),
        F.array_sort(F.collect_list(per_model)).alias("per_model"))
    shown = [c for c in ("model", "params", score, "test_f1") if c in results.columns]
    best = top_candidates(results, n, score).where(F.col(score).isNotNull())
    order = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("_s"), F.col("ordinal"), *shown)))
    top = best.agg(F.transform(order, lambda x, i: F.struct((i + 1).alias("place"), x["ordinal"].alias("ordinal"), *[x[c].alias(c) for c in shown])).alias("top"))
    both = counts.unionByName(top, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns]).select(
        F.lit(run_ts).alias("run_ts"), F.lit(args).alias("args"), *both.columns)
