from itertools import combinations

import numpy as np

from pyspark.sql import functions as F

from creditloom.llm.decontaminate import MASKS, clean, overlaps

VOCAB = [f"word{i}" for i in range(3000)]


def test_masks_hit_every_window_with_two_substitutions():
    for n in (0, 1, 2):
        for wrong in combinations(range(13), n):
            assert any(not {s + o for o in m} & set(wrong) for m in MASKS for s in range(13 - m[-1]))


def norm(t):
    return ["".join(c if c.isalnum() or ord(c) > 127 else " " for c in w) for w in [(t or "").lower()]][0].split()


def brute(docs, items, least=13, share=0.8):
    """Pairs with a window of 13 words that differs in two at most, or a whole shorter item."""
    out = {}
    for d, text in docs:
        h = norm(text)
        for i, item in items:
            b = norm(item)
            need = min(least, len(b))
            for start in range(-len(b) + 1, len(h)):
                same = [(p, p - start) for p in range(max(0, start), min(len(h), start + len(b)))]
                eq = [h[p] == b[q] for p, q in same]
                # only alignments that a window of `least` words with two substitutions, or the item, shares
                for a in range(len(eq) - need + 1):
                    if sum(eq[a:a + need]) >= need - (2 if len(b) >= least else 0):
                        out[d, i] = True
    return set(out)


def planted():
    rng = np.random.default_rng(6)
    items = [(i, " ".join(rng.choice(VOCAB, n))) for i, n in enumerate([5, 9, 12, 13, 14, 20, 40, 60, 200])]
    docs, want = [], set()
    for d in range(120):
        own = list(rng.choice(VOCAB, int(rng.integers(0, 80))))
        if d % 2:
            i, text = items[int(rng.integers(len(items)))]
            part = text.split()
            if len(part) > 13:
                n = int(rng.integers(13, len(part) + 1))
                a = int(rng.integers(0, len(part) - n + 1))
                part = part[a:a + n]
                for k in rng.choice(n, min(2, n // 8), replace=False):
                    part[k] = "other"
            at = int(rng.integers(0, len(own) + 1))
            own = own[:at] + [w.upper() + "," for w in part] + own[at:]
            want.add((d, i))
        docs.append((d, " ".join(own)))
    return docs, items, want


def test_planted_passages_and_brute_force(spark):
    docs, items, want = planted()
    docs += [(900, None), (901, ""), (902, "!!! ..."), (None, items[6][1]), (903, items[0][1].split()[0])]
    got = overlaps(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int"),
                   spark.createDataFrame(items + [(50, items[6][1]), (51, None), (52, " ."), (None, "x y z")], "item_id long, text string"))
    rows = got.collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert want | {(None, 6)} <= found
    assert found - {(None, 6)} == brute(docs, items) - {(None, 6)}
    assert all(r.n_equal <= r.n_words and r.n_equal >= 11 or r.n_equal == r.n_words for r in rows)


def test_blocks_of_the_benchmark_agree(spark):
    docs, items, want = planted()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(overlaps(d, b, block_words=100).collect()) == sorted(overlaps(d, b).collect())


def test_clean_keeps_the_rest_as_it_is(spark):
    docs, items, want = planted()
    d = spark.createDataFrame([(i, t, "s") for i, t in docs] + [(None, "no id", "s")], "doc_id long, text string, source string")
    b = spark.createDataFrame(items, "item_id long, text string")
    left = clean(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want} | {None}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert overlaps(none, b).collect() == [] and overlaps(d, none.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_items_without_an_id_and_short_items(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "yes we know"), (3, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(words[5:30])), (None, " ".join(words[35:55])), (4, "yes")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_words) for r in overlaps(docs, items).collect() if r.item_id is None)
    assert got == [(1, None, 20), (1, None, 25)]
    assert sorted(r.doc_id for r in clean(docs, items).collect()) == [3]
    assert sorted(r.doc_id for r in clean(docs, items, shortest=13).collect()) == [2, 3]


def test_clean_judges_each_row_by_its_text(spark):
    leak = " ".join(f"w{i}" for i in range(20))
    rows = [(None, f"before {leak} after", "a"), (None, "nothing of the kind", "b"), (7, leak, "c"), (7, "a clean row of the same id", "d"),
            (8, None, "e"), (None, "", "f"), (9, ("clean words " * 30000) + leak, "g"), (9, "clean words " * 30000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("_text", F.lit("clash"))
    items = spark.createDataFrame([(1, leak), (2, "another item of thirteen words that no document has at all, none of them")], "item_id long, text string")
    for words in (1 << 20, 8):
        got = clean(docs, items, block_words=words)
        assert got.columns == docs.columns
        assert sorted(r.row for r in got.collect()) == ["b", "d", "e", "f", "h"]
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert clean(docs, items.where("false")).count() == len(rows)
    assert clean(docs.where("false"), items).count() == 0
