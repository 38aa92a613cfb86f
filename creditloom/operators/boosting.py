"""Second-order boosting of histogram trees, grown leaf by leaf.

Features become bins once. A pass over the rows sums gradients, curvatures and rows per (output, node,
feature, bin) inside each task and adds the sums up with one aggregation; the best cut of every open
node is found by windows over bins, so the driver sees one row per node. A node's best cut does not
depend on other nodes, so all nodes that best-gain-first growth may want next are opened in one pass, and
the tree is what that order picks from them. Predictions of stored trees are carried along with the
rows and written to the shared folder every few rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditloom.operators.sizing import settle


@dataclass
class BoostSettings:
    """``reg_alpha`` shrinks a node's gradient sum towards 0, ``reg_lambda`` adds to its curvature, ``gamma`` is the gain a cut
    must exceed, ``min_child_weight`` the curvature either side needs. No depth limit: None."""

    rounds: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int | None = None
    bins: int = 64
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    settle_every: int = 8

    @classmethod
    def from_names(cls, params: dict) -> BoostSettings:
        """From parameter names of published searches. A depth of -1 or None is no limit; a depth
        without a number of leaves allows as many leaves as the depth does."""
        names = {"n_estimators": "rounds", "max_bin": "bins", "min_split_loss": "gamma", "lambda_l1": "reg_alpha", "lambda_l2": "reg_lambda"}
        known = {names.get(k, k): v for k, v in params.items()}
        unknown = sorted(set(known) - set(cls.__dataclass_fields__))
        if unknown:
            raise ValueError(f"unknown parameters: {unknown}")
        if known.get("max_depth") in (-1, None):
            known["max_depth"] = None
        elif "num_leaves" not in known:
            known["num_leaves"] = 1 << int(known["max_depth"])
        return cls(**known)


@dataclass
class Tree:
    """Nodes by number, 0 the root; ``feature`` -1 marks a leaf. Rows at most at ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin_: int, gain: float) -> tuple[int, int]:
        kids = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.gain[node] = feature, bin_, gain
        self.left[node], self.right[node] = kids
        for _ in kids:
            for name, start in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0)):
                getattr(self, name).append(start)
            self.depth.append(self.depth[node] + 1)
        return kids

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            node = np.where(inner, np.where(bins[rows, f] <= cut[node], left[node], right[node]), node)


def _margins(base: np.ndarray, trees: list[list[Tree]], bins: np.ndarray) -> np.ndarray:
    out = np.tile(base, (len(bins), 1)) if base.ndim == 1 else base.copy()
    for group in trees:
        for k, tree in enumerate(group):
            out[:, k] += np.array(tree.value)[tree.leaves_of(bins)]
    return out


def _probabilities(margins: np.ndarray) -> np.ndarray:
    """One column per class: a logistic pair for one output, else a softmax."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.column_stack([1 - p, p])
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def feature_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending cuts per feature; values up to a cut lie below it. A feature of at most ``bins`` values is cut at all
    of them, others at approximate quantiles. Nulls and NaN take no part: they have a bin of their own, below all others."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("x"))
    values = settle(values.select("x.*").where("v is not null and not isnan(v)").groupBy("f", "v").agg(F.count("*").alias("n")))
    few = values.groupBy("f").agg(F.count("*").alias("k")).where(F.col("k") <= bins).select("f")
    rows = values.join(few, "f").groupBy("f").agg(F.sort_array(F.collect_list("v")).alias("c")).collect()
    cuts = {r.f: r.c[:-1] for r in rows}
    rest = [i for i in range(len(features)) if i not in cuts]
    if rest:
        at = [i / bins for i in range(1, bins)]
        clean = [F.when(~F.isnan(F.col(features[i]).cast("double")), F.col(features[i]).cast("double")) for i in rest]
        got = df.agg(*[F.percentile_approx(c, at, 100 * bins).alias(f"q{i}") for i, c in zip(rest, clean)]).first()
        cuts |= {i: got[f"q{i}"] or [] for i in rest}
    return [np.unique(np.array(cuts[i], dtype=np.float64)) for i in range(len(features))]


def _binned(columns: list, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of a row's features from 1; 0 is for missing values."""
    out = []
    for values, c in zip(columns, cuts):
        v = np.asarray(values, dtype=np.float64)
        out.append(np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v)))
    return np.column_stack(out).astype(np.uint8) if out else np.zeros((0, 0), dtype=np.uint8)


class BoostedTrees:
    """A fitted model: classes in order, features with their cuts, and one tree per round and output."""

    def __init__(self, classes: list, features: list[str], cuts: list[np.ndarray], base: np.ndarray, trees: list[list[Tree]]):
        self.classes, self.features, self.cuts, self.base, self.trees = classes, features, cuts, base, trees

    def probability(self) -> Column:
        """The classes' probabilities, from columns with the features' names."""
        cuts, base, trees = self.cuts, self.base, self.trees

        @F.pandas_udf("array<double>")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(_probabilities(_margins(base, trees, _binned(list(columns), cuts)))))

        return score(*[F.col(c).cast("double") for c in self.features])

    def predict(self, df: DataFrame, probability: str = "probability", prediction: str = "prediction") -> DataFrame:
        """Adds the probabilities and the likeliest class (ties: the first)."""
        out = df.withColumn(probability, self.probability())
        at = F.array_position(probability, F.array_max(probability)).cast("int")
        return out.withColumn(prediction, F.get(F.array(*[F.lit(c) for c in self.classes]), at - 1))

    def rows(self) -> list[tuple]:
        """``round, output, path, feature, cut, gain, value`` of all nodes; a path tells the way from the root in L and R."""
        out = []
        for number, group in enumerate(self.trees):
            for k, t in enumerate(group):
                todo = [(0, "")]
                while todo:
                    node, path = todo.pop()
                    f = t.feature[node]
                    if f < 0:
                        out.append((number, k, path, None, None, None, t.value[node]))
                    else:
                        out.append((number, k, path, self.features[f], float(self.cuts[f][t.bin[node] - 1]) if t.bin[node] else -np.inf, t.gain[node], None))
                        todo += [(t.left[node], path + "L"), (t.right[node], path + "R")]
        return out


_SUMS = "k int, node int, f int, b int, g double, h double, n long"


def _node_sums(state: DataFrame, recent: list[list[Tree]], growing: list[Tree], wanted: list[list[int]], width: int, bins: int) -> DataFrame:
    """Sums of gradients and curvatures per bin of the wanted nodes, added up within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((3, len(w) * width * bins)) for w in wanted]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)
            stored = batch.column("margins").flatten().to_numpy().reshape(len(x), -1)
            margins, label = _margins(stored, recent, x), batch.column("label").to_numpy()
            p = _probabilities(margins)
            for k, nodes in enumerate(wanted):
                if not nodes:
                    continue
                one = 1 if margins.shape[1] == 1 else k
                slot = np.full(len(growing[k].feature), -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[growing[k].leaves_of(x)]
                mine = at >= 0
                g, h = (p[:, one] - (label == one))[mine], (p[:, one] * (1 - p[:, one]))[mine]
                cell = ((at[mine][:, None] * width + np.arange(width)) * bins + x[mine]).ravel()
                for i, w in enumerate((g, h, np.ones(len(g)))):
                    sums[k][i] += np.bincount(cell, weights=np.repeat(w, width), minlength=sums[k].shape[1])
        for k, nodes in enumerate(wanted):
            some = np.nonzero(sums[k][2])[0]
            if len(some):
                columns = (np.full(len(some), k), np.array(nodes)[some // (width * bins)], some // bins % width, some % bins)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns], pa.array(sums[k][0][some]), pa.array(sums[k][1][some]),
                                                  pa.array(sums[k][2][some].astype(np.int64))], ["k", "node", "f", "b", "g", "h", "n"])

    return state.mapInArrow(run, _SUMS).groupBy("k", "node", "f", "b").agg(*[F.sum(c).alias(c) for c in "ghn"])


def best_cuts(sums: DataFrame, s: BoostSettings) -> DataFrame:
    """``k, node, g, h`` of each node with ``best``: gain, feature, bin and the left side's sums; null without a cut that
    is allowed. Ties go to the first feature, then the lowest bin."""

    def strength(g: Column, h: Column) -> Column:
        shrunk = F.signum(g) * F.greatest(F.abs(g) - s.reg_alpha, F.lit(0.0))
        return F.when(h + s.reg_lambda > 0, shrunk * shrunk / (h + s.reg_lambda)).otherwise(0.0)

    whole = W.partitionBy("k", "node", "f")
    upto = whole.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    c = sums.select("k", "node", "f", "b", *[F.sum(x).over(upto).alias(f"{x}l") for x in "ghn"], *[F.sum(x).over(whole).alias(x) for x in "ghn"])
    gain = 0.5 * (strength(F.col("gl"), F.col("hl")) + strength(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - strength(F.col("g"), F.col("h")))
    ok = (F.col("nl") < F.col("n")) & (F.col("hl") >= s.min_child_weight) & (F.col("h") - F.col("hl") >= s.min_child_weight) & (F.col("gain") > s.gamma)
    order = F.when(ok, F.struct("gain", -F.col("f"), -F.col("b")))
    return c.withColumn("gain", gain).groupBy("k", "node").agg(
        F.min_by("g", "f").alias("g"), F.min_by("h", "f").alias("h"), F.max_by(F.struct("gain", "f", "b", "gl", "hl"), order).alias("best"))


class _Grower:
    """A tree with every node opened so far, of which growth by the best gain picks some."""

    def __init__(self, s: BoostSettings):
        self.s, self.tree = s, Tree()
        self.sums: dict[int, tuple[float, float]] = {}
        self.best: dict[int, object] = {}

    def pick(self) -> tuple[dict[int, tuple[int, int]], list[int]]:
        """The nodes to split so far, with their children, and leaves whose best cut is not known yet."""
        split, unknown, leaves, heap = {}, [], 1, []

        def look(node: int) -> None:
            if node not in self.best and (self.s.max_depth is None or self.tree.depth[node] < self.s.max_depth):
                unknown.append(node)
            elif self.best.get(node) is not None:
                heapq.heappush(heap, (-self.best[node].gain, node))

        look(0)
        while heap and leaves < self.s.num_leaves:
            _, node = heapq.heappop(heap)
            b = self.best[node]
            if self.tree.feature[node] < 0:
                left, right = self.tree.split(node, b.f, b.b, b.gain)
                g, h = self.sums[node]
                self.sums[left], self.sums[right] = (b.gl, b.hl), (g - b.gl, h - b.hl)
            split[node] = self.tree.left[node], self.tree.right[node]
            leaves += 1
            for kid in split[node]:
                look(kid)
        return split, unknown

    def finish(self, split: dict[int, tuple[int, int]]) -> Tree:
        """The picked tree with its leaves' values."""
        out, todo = Tree(), [(0, 0)]
        while todo:
            old, new = todo.pop()
            if old in split:
                t = self.tree
                todo += list(zip(split[old], out.split(new, t.feature[old], t.bin[old], t.gain[old])))
            else:
                g, h = self.sums.get(old, (0.0, 0.0))
                shrunk = np.sign(g) * max(abs(g) - self.s.reg_alpha, 0.0)
                out.value[new] = float(-self.s.learning_rate * shrunk / (h + self.s.reg_lambda)) if h + self.s.reg_lambda > 0 else 0.0
        return out


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, settings: BoostSettings | None = None) -> BoostedTrees:
    """Trees for the classes in ``label``, in ascending order: one output for two classes, else one each.

    Rows without a label are left out. Null and NaN features lie below all values. Scores start at 0. With one
    class alone, or without rows, no tree is grown and every class is equally likely.
    """
    s = settings or BoostSettings()
    if not 2 <= s.bins <= 255:
        raise ValueError("bins must be 2 to 255")
    known = df.where(F.col(label).isNotNull())
    classes = [r[0] for r in known.select(label).distinct().orderBy(label).collect()]
    features = list(features)
    outputs = 1 if len(classes) <= 2 else len(classes)
    base = np.zeros(outputs)
    if len(classes) < 2:
        return BoostedTrees(classes, features, [np.zeros(0)] * len(features), np.zeros(max(1, outputs)) if classes else base, [])
    cuts = feature_cuts(known, features, s.bins)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _binned([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(len(features))], cuts)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary()),
                                              pa.array([[0.0] * outputs] * len(x), pa.list_(pa.float64()))], ["label", "bins", "margins"])

    columns = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    schema = "label int, bins binary, margins array<double>"
    state = settle(known.select(number.cast("int").alias("label"), *columns).mapInArrow(start, schema))
    trees, recent = [], []
    for _ in range(s.rounds):
        growers = [_Grower(s) for _ in range(outputs)]
        while True:
            picked = [g.pick() for g in growers]
            wanted = [unknown for _, unknown in picked]
            if not any(wanted):
                break
            found = best_cuts(_node_sums(state, recent, [g.tree for g in growers], wanted, len(features), s.bins + 1), s).collect()
            for k, nodes in enumerate(wanted):
                growers[k].best.update(dict.fromkeys(nodes))
            for r in found:
                growers[r.k].best[r.node] = r.best
                growers[r.k].sums.setdefault(r.node, (r.g, r.h))
        group = [g.finish(split) for g, (split, _) in zip(growers, picked)]
        trees.append(group)
        recent.append(group)
        if len(recent) >= s.settle_every:
            state, recent = settle(state.mapInArrow(_carry(recent, len(features)), schema)), []
    return BoostedTrees(classes, features, cuts, base, trees)


def _carry(recent: list[list[Tree]], width: int):
    """Adds the predictions of recent trees to the rows' margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)
                stored = batch.column("margins").flatten().to_numpy().reshape(len(x), -1)
                moved = pa.array(list(_margins(stored, recent, x)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("bins"), moved], ["label", "bins", "margins"])

    return run
