import math

import numpy as np
import pytest

from creditloom.llm.mixing import mix


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water-filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        new = {s for s in rest if w[s] * level > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else w[s] * level for s in order}
        full |= new


def corpus():
    rng = np.random.default_rng(9)
    rows = []
    for s, n in (("b", 300), ("a", 900), ("é", 40), ("Z", 200), (None, 60), ("one", 1), ("none", 5), ("~", 3)):
        rows += [(s, "" if s == "none" else "w " * int(rng.pareto(1.5) * 30 + rng.integers(0, 3))) for _ in range(n)]
    return [(i, t, s, "x") for i, (s, t) in enumerate(rows)]


def check(rows, got):
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    by_id = {i: (len((t or "").split()), s) for i, t, s, _ in rows}
    for r in got:
        size, s = by_id[r.doc_id]
        assert r.size == size and r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[s] += r.taken
        largest[s] = max(largest[s], size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 0.5 * largest[s])


def test_targets_and_rounding(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = mix(docs.repartition(13)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def plain_tilt(sizes, target, most=2.0):
    """The multiplier of one source by bisection."""
    given = lambda x: sum(s * math.exp(min(x * s, math.log(most))) for s in sizes)
    lo, hi = -100.0, math.log(most) / min(sizes)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if given(mid) < target else (lo, mid)
    return lo


def test_rates_solve_the_dual(spark):
    by_source = {}
    for r in mix(spark.createDataFrame(corpus(), "doc_id long, text string, source string, size string")).collect():
        by_source.setdefault((r.source_size, r.target), []).append(r)
    tilted = 0
    for (size, target), rows in by_source.items():
        rows = [r for r in rows if r.size]
        if not rows:
            continue
        assert math.isclose(sum(r.rate * r.size for r in rows), target, rel_tol=1e-6)
        if target < 2 * size:
            tilted += len({r.rate for r in rows}) > 1
            x = plain_tilt([r.size for r in rows], target)
            assert all(math.isclose(r.rate, math.exp(min(x * r.size, math.log(2))), rel_tol=1e-5, abs_tol=1e-12) for r in rows)
        else:
            assert all(r.rate == 2 for r in rows)
    assert tilted >= 2


def test_one_very_long_text(spark):
    """A text that holds nearly all words of its source."""
    rows = [(i, "w " * n, s, "x") for i, (s, n) in enumerate([("a", 200_000), *[("a", 1 + k % 7) for k in range(400)], *[("b", 50)] * 900])]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string")).collect()
    assert len(got) == len(rows)
    check(rows, got)


@pytest.mark.parametrize("rows", [[], [(1, None, None, "x")], [(1, "a b c", "s", "x")], [(1, "a b", "s", "x"), (1, "a b", "s", "x"), (None, "c", "t", "x")]])
def test_odd_tables(spark, rows):
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string")).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size for r in got)
