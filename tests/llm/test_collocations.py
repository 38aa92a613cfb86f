import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditloom.llm.collocations import collocations, parts_of, piece_words
from creditloom.llm.quotient_filter import Keys, Merger

UP, LOW = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def brute(rows, longest=3, least=10, share=50, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        t = (text or "").encode().translate(bytes.maketrans(UP, LOW)).decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[s:s + m] for p, a in cands.items() for m in range(2, len(p)) for s in range(len(p) - m + 1) if 100 * a >= share * cands[p[s:s + m]]}
        scored = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def text(rng, n):
    return "".join(rng.choice(["a", "B", "c", "ä", "d"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r", ",", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("how", [{}, {"longest": 4, "least": 3, "share": 80, "top": 7},
                                 {"chunk_bytes": 50, "filter_keys": 4, "range_keys": 1, "step_bits": 2}, {"longest": 2, "least": 1}])
def test_against_brute_force(spark, how):
    rng = random.Random(4)
    rows = [(text(rng, rng.randrange(60)), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" \t\n", "xx"), (text(rng, 5000), "en")] + [("Same words here again", "fr")] * 30
    docs = spark.createDataFrame([(*r, "z") for r in rows], "text string, lang string, word string")  # a clashing name
    got = collocations(docs, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, **{k: v for k, v in how.items() if k in ("longest", "least", "share", "top")})


def test_no_rows(spark):
    schema = "text string, lang string"
    assert collocations(spark.createDataFrame([], schema)).collect() == []
    assert collocations(spark.createDataFrame([("few words only", "en"), (None, None)], schema)).collect() == []
    with pytest.raises(ValueError):
        collocations(spark.createDataFrame([], schema), longest=1)


def test_long_texts_are_cut_between_pieces():
    t = ("one two three, four. " * 300).encode()
    whole = [w for w in b" ".join(piece_words(t)).split(b"\n")]
    cut = [w for p in parts_of(t, 100) for w in b" ".join(piece_words(p)).split(b"\n")]
    assert [w.strip() for w in whole if w.strip()] == [w.strip() for w in cut if w.strip()]
    assert list(parts_of(b"x" * 500, 100)) == [b"x" * 500]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 42), st.integers(2, 3), st.integers(0, 12), st.lists(st.tuples(*[st.integers(0, 2**42)] * 3, st.integers(1, 2**40)), min_size=1, max_size=60))
def test_filters_lose_nothing(bits, length, range_bits, rows):
    keys = Keys(length, bits)
    columns = [np.array([r[i] % (1 << bits) for r in rows]) for i in range(length)]
    counts = np.array([r[3] for r in rows])
    want = Counter()
    for *k, n in zip(*columns, counts):
        want[tuple(int(x) for x in k)] += int(n)
    hi, lo, sums = keys.tally(*keys.pack(columns), counts)
    merger = Merger(keys, 10)
    half = len(hi) // 2
    for part in (slice(0, half), slice(half, None), slice(0, None)):
        for number, block in keys.blocks(hi[part], lo[part], sums[part], range_bits):
            merger.add(*keys.read(number, block))
    hi, lo, sums = merger.take()
    assert {k: 2 * n for k, n in want.items()} == dict(zip(zip(*(c.tolist() for c in keys.unpack(hi, lo))), sums.tolist()))
    assert len(set(zip(hi.tolist(), lo.tolist()))) == len(hi)


def test_ids_that_do_not_fit():
    with pytest.raises(ValueError):
        Keys(4, 33)
