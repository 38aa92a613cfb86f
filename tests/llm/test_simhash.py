import re

import numpy as np
import xxhash

from creditloom.llm.graph import components
from creditloom.llm.simhash import near_duplicates, refine, shingle_hashes, similar_groups, wide_radius, within_radius


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in ([b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)] * bool(w))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(values, radius):
    """Smallest reachable id by links between all pairs."""
    root = {i: i for i in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(values)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    out = []
    for n in (1, 2, 3, 4, 30, 300, 5000):
        base = rng.choice(words, n)
        out += [" ".join(base), " ".join(base).upper(), "\t".join(base)]
        for _ in range(6):
            other = base.copy()
            other[rng.integers(n)] = "changed"
            out.append(" ".join(other))
    return out + ["", " \n", "!!!"]


def test_matches_brute_force(spark):
    rows = [(i * 3, t, "src") for i, t in enumerate(texts())] + [(1000, None, "src"), (0, texts()[0], "src")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    fps = {i: fingerprint(t) for i, t, _ in rows}
    want = brute(fps, 2)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_over_full_buckets_are_split_exactly(spark):
    """A bucket limit of 4 sends everything through the finer levels."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    values = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 63, (60, 2))}
    from pyspark.sql import functions as F

    from creditloom.llm.simhash import links

    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in components(links(frame, bucket=4)).collect()}
    want = brute({v: v for v in values}, 2)
    assert {v: roots.get(v, v) for v in values} == want
    assert frame.agg(F.count("*")).first()[0] == len(values)


def test_masks_meet_all_pairs():
    for mask in (0, refine(0)[3], refine(refine(0)[1])[5]):
        free = [b for b in range(64) if not mask >> b & 1]
        for i in free:
            for j in free:
                assert any(not m >> i & 1 and not m >> j & 1 for m in refine(mask))


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    for words, radius in ((1, 0), (1, 1), (1, 2), (1, 3), (2, 28)):
        base = rng.integers(0, 1 << 63, (40, words), dtype=np.uint64)
        near = np.concatenate([base] + [base ^ np.uint64(1 << int(rng.integers(63))) for _ in range(radius + 8)])
        near = np.unique(near, axis=0)
        i, j = within_radius(near, radius)
        distance = np.bitwise_count(near[:, None, :] ^ near[None, :, :]).sum(axis=2)
        want = {(a, b) for a, b in zip(*np.nonzero(distance <= radius)) if a < b}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (2001, 2000), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)} | {2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_similar_groups(spark):
    rng = np.random.default_rng(4)
    rows, family = [], {}
    for g in range(12):
        base = rng.choice([f"v{i}" for i in range(4000)], 300)
        for k in range(5):
            other = base.copy()
            other[rng.integers(0, 300, 4 * (k > 0))] = f"x{k}"
            family[len(rows)] = g
            rows.append((len(rows), " ".join(other)))
    rows += [(500, "alone " * 3 + "here"), (501, None), (502, ""), (None, "no id")]
    for bucket in (4096, 3):
        got = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
        assert got[501] == got[502] == 501 and got[500] == 500 and None not in got
        hit = sum(got[i] == 5 * g for i, g in family.items())
        assert hit == len(family) if bucket == 4096 else hit >= 0.9 * len(family)
        assert all(i not in family or family[i] == family[c] for i, c in got.items())
    assert 20 < wide_radius(0.8) < 32


def grouped(spark, rows, **how):
    return {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}


def jaccard(a, b):
    a, b = (set(shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_only_checked_links(spark):
    """Pairs below the similarity stay, however near their fingerprints are."""
    rng = np.random.default_rng(12)
    vocab, rows = [f"v{i}" for i in range(3000)], []
    for g in range(40):
        base = rng.choice(vocab, 400)
        other = base.copy()
        other[400 - int(rng.integers(60, 200)):] = "z"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other[: np.argmax(other == "z")]) + " " + " ".join(rng.choice(vocab, 60)))]
    assert all(0.3 < jaccard(rows[k][1], rows[k + 1][1]) < 0.78 for k in range(0, 80, 2))
    rows += [(1000 + i, " ".join(rng.choice(vocab, 6))) for i in range(3000)]
    rows += [(9000 + i, "one two three four five " + w) for i, w in enumerate(vocab[:500])]
    assert all(i == c for i, c in grouped(spark, rows).items())


def test_result_does_not_depend_on_the_bucket(spark):
    """A group of copies of one text, alike to it but not all to each other, and a chain."""
    rng = np.random.default_rng(13)
    base = rng.choice([f"v{i}" for i in range(3000)], 200)
    rows = [(0, " ".join(base))]
    for k in range(1, 160):
        other = base.copy()
        for at in rng.choice(np.arange(5, 195, 10), int(rng.integers(1, 5)), replace=False):
            other[at] = f"x{k}-{at}"
        rows.append((k, " ".join(other)))
    chain = [f"c{i}" for i in range(300)]
    rows += [(500 + k, " ".join(chain[3 * k: 3 * k + 150])) for k in range(40)]
    got = [grouped(spark, rows, bucket=b) for b in (4096, 40, 7)]
    assert got[0] == got[1] == got[2]
    assert all(got[0][k] == (0 if k < 500 else 500) for k, _ in rows)


def at_least(rng, vocab, n, replace):
    """Two texts of about n shingles whose similarity is 0.8 or just above."""
    base = list(rng.choice(vocab, n + 4, replace=False))
    k = n // 9
    other = base[:-k] + [f"r{x}" for x in rng.integers(0, 1 << 40, k)] if replace and k else base[: len(base) - n // 5]
    return " ".join(base), " ".join(other)


def test_recall_by_size(spark):
    """Pairs at 0.80 to 0.85: all are found among short texts, nearly all among longer ones."""
    rng = np.random.default_rng(21)
    vocab, rows, of, pairs = [f"v{i}" for i in range(5000)], [], {}, 60
    for n in (5, 6, 10, 11, 18, 20, 27, 30, 36, 45, 64, 150, 400, 1000):
        for k in range(pairs):
            both = at_least(rng, vocab, n, k % 2)
            assert 0.8 <= jaccard(*both) < 0.86
            of[len(rows)] = n
            rows += [(len(rows), both[0]), (len(rows) + 1, both[1])]
    got = grouped(spark, rows)
    hits = {n: sum(got[i + 1] == i for i in of if of[i] == n) / pairs for n in set(of.values())}
    assert all(hits[n] == 1 for n in hits if n <= 32), hits
    assert min(hits.values()) >= 0.9 and sum(hits.values()) / len(hits) >= 0.95, hits
    assert all(got[i] == i for i in of)


def test_short_texts_against_all_pairs(spark):
    """Short texts that share common beginnings, and a large group of near copies: the same groups as by brute force."""
    rng = np.random.default_rng(22)
    opening = "we are happy to tell you today".split()
    rows = []
    for g in range(60):
        base = opening + [f"t{x}" for x in rng.integers(0, 400, int(rng.integers(3, 26)))]
        for _ in range(4):
            rows.append((len(rows), " ".join(base[: len(base) - int(rng.integers(0, 4))] + [f"e{x}" for x in rng.integers(0, 50, int(rng.integers(0, 3)))])))
    rows += [(len(rows) + k, " ".join([f"h{x}" for x in range(24)] + [f"end{k}"])) for k in range(150)]
    sets = [set(shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(rows))}
    assert len(set(want.values())) < len(rows) / 2
    for bucket in (4096, 20):
        assert grouped(spark, rows, bucket=bucket) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).collect() == [] and similar_groups(none).collect() == []
