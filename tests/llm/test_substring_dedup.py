import hashlib
import re

import numpy as np
import pytest

from creditloom.llm.substring_dedup import deep_nodes, remove_repeats, tree_repeats


def brute(rows, window):
    """Kept words per row, straight from the definition."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    last = float("inf")
    first = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (last if i is None else i):
                gone |= set(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(200)] + ["é", "ß,"]
    passage = list(rng.choice(vocab, 80))
    rows = []
    for i in range(60):
        own = list(rng.choice(vocab, int(rng.integers(0, 150))))
        if i % 3 == 0:
            a, b = sorted(rng.integers(0, 81, 2))
            cut = int(rng.integers(0, len(own) + 1))
            own = own[:cut] + passage[a:b] + own[cut:]
        rows.append((i * 7 % 60, " ".join(own)))
    rows += [(100, rows[3][1]), (101, rows[3][1].replace(" ", "\n\t ")), (102, "same " * 300), (103, "same " * 200), (104, "ab cd " * 100),
             (105, "ab cd " * 90 + "x"), (106, None), (107, ""), (108, " \n"), (None, rows[5][1]), (None, "same " * 70), (102, "same " * 300), (102, "ab cd " * 60)]
    return rows


@pytest.mark.parametrize("window,group_words", [(50, 1_000_000), (50, 1), (8, 300), (2, 100)])
def test_matches_brute_force(spark, window, group_words):
    rows = corpus()
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, marks string")
    got = remove_repeats(docs, window=window, group_words=group_words).withColumn("kept_text", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_deep_nodes():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 400)
    for depth in (1, 2, 3, 5, 8, 50):
        node = deep_nodes(words, depth)
        by_words = {}
        for s in range(len(words) - depth + 1):
            assert by_words.setdefault(tuple(words[s:s + depth]), node[s]) == node[s]
        assert len(set(by_words.values())) == len(by_words)


def test_tree_repeats_stay_within_segments():
    a, b = [b"x"] * 4, [b"x"] * 3
    assert tree_repeats([a, b], np.array([1, 2]), 3) == [(1, 0, 3)]
    assert tree_repeats([b[:2], a[:2]], np.array([1, 2]), 3) == []
