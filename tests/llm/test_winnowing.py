import hashlib

import numpy as np
import pytest

from creditloom.llm.winnowing import digest, edit_likeness, fingerprints, gram_hashes, likeness, winnow


def test_rolling_hashes_depend_on_the_run_alone():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 500)
    for k in (1, 2, 3, 7, 10, 16):
        h = gram_hashes(x, k)
        assert len(h) == 500 - k + 1
        by = {}
        for i in range(len(h)):
            assert by.setdefault(tuple(x[i:i + k]), h[i]) == h[i]
        assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("k,w", [(4, 5), (10, 10), (3, 1)])
def test_choice_matches_definition(k, w):
    rng = np.random.default_rng(2)
    texts = ["", "a", "abc", "aaaa" * 20, "🦙é" * 30] + ["".join(rng.choice(list("abcé "), int(n))) for n in rng.integers(0, 200, 40)]
    for text, (hashes, positions) in zip(texts, winnow(texts, k, w)):
        n = len(text)
        if n < k:
            assert len(hashes) == (n > 0)
            continue
        h = gram_hashes(np.array([ord(c) for c in text]), k) & ~np.uint64(1)
        want = set()
        for s in range(max(1, len(h) - w + 1)):
            part = h[s:s + w]
            want.add(s + len(part) - 1 - int(np.argmin(part[::-1])))
        assert positions.tolist() == sorted(want) and hashes.tolist() == h[sorted(want)].tolist()


def test_match_guarantee():
    rng = np.random.default_rng(3)
    k, w = 10, 10
    passage = "".join(rng.choice(list("abcdefgh"), k + w - 1))
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abcdefgh"), 60)) + passage + "".join(rng.choice(list("abcdefgh"), 40)) for _ in range(2))
        (ha, pa), (hb, _) = winnow([a, b], k, w)
        shared = {int(p) for h, p in zip(ha, pa) if h in set(hb.tolist())}
        assert any(60 <= p <= 60 + len(passage) - k for p in shared)


def test_edits_follow_descending_ids(spark):
    rng = np.random.default_rng(4)
    texts = {i * 5: "".join(rng.choice(list("abcdefg é🦙"), int(rng.integers(0, 300)))) for i in range(150)}
    texts[3] = None
    got = {r.doc_id: r for r in edit_likeness(spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n_chars int")).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(texts)
    for n, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        own, new, other = winnow([text, edited, after])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest(own), digest(new))
        assert r.near_edited == likeness(own[0], new[0]) and r.near_next == likeness(own[0], other[0])


def test_small_and_odd_tables(spark):
    schema = "doc_id long, text string"
    assert edit_likeness(spark.createDataFrame([], schema)).collect() == []
    one = edit_likeness(spark.createDataFrame([(7, "abcabc")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcaab").hexdigest() and one.near_next == 1.0
    rows = [(1, "x" * 30), (1, "x" * 30), (1, "y" * 30), (None, "z" * 30), (None, None)]
    assert len(edit_likeness(spark.createDataFrame(rows, schema)).collect()) == 5
    assert len(fingerprints(spark.createDataFrame(rows, schema)).collect()) == 5
