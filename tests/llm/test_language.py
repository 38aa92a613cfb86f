import zlib

import numpy as np
import pytest

from creditloom.llm.language import CLASSES, OTHER, SINGLE, automaton, fit, identify, phrases, rates, symbols


def parsed(text, sample):
    """Phrases of a greedy parse, with plain string search."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample and text[at:at + size] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_automaton_parses_like_string_search():
    rng = np.random.default_rng(1)
    sample = "".join(rng.choice(list("abc"), 400))
    table = automaton(np.array([ord(c) - 96 for c in sample], dtype=np.uint8))
    texts = sorted(("".join(rng.choice(list("abcd"), int(n), p=[.3, .3, .3, .1])) for n in rng.integers(1, 90, 60)), key=len, reverse=True)
    sizes = np.array([len(t) for t in texts])
    blocks = np.zeros((sizes[0], len(texts)), dtype=np.uint8)
    for k, t in enumerate(texts):
        blocks[:len(t), k] = [ord(c) - 96 for c in t]
    assert phrases(blocks, sizes, table).tolist() == [parsed(t, sample) for t in texts]
    assert table.max() // 4 < len(table) and len(table) % CLASSES == 0


def test_symbols():
    model = fit({"x": ["abc abc"], "y": ["Äöü"]})
    seq, sizes, letters = symbols(["", "A b,, c1", "123", "ÄΩ"], model["letters"], model["width"])
    assert sizes.tolist() == [0, 6, 0, 3] and letters.tolist() == [0, 3, 0, 2]  # one blank for a run, and one at a text's end
    assert seq[0] == model["letters"][ord("a")] and seq[1] == 0


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_held_out_accuracy(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identify(docs).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)


def test_labels_of_held_out_documents_change_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = docs.withColumns({"lang": F.when(held, F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("?")})
    assert sorted(map(tuple, identify(docs).collect())) == sorted(map(tuple, identify(other).collect()))


def test_odd_rows(spark):
    rows = [(i, f"der hund und die katze {i}", "de", 1) for i in range(0, 40, 2)] + [(i, f"the dog and the cat {i}", "en", 1) for i in range(1, 40, 2)]
    rows += [(100, None, "de", 1), (101, "", "en", 1), (102, "123 !?", None, 1), (103, "the cat and", None, 1), (None, "und die katze", "en", 1), (103, "the cat and", None, 1),
             (104, "the dog and the cat " * 20000, None, 1)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), keep_row=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, 103, None, 104)] == ["und", "und", "und", "en", "de", "en"]
    assert by[100].score == 0 and by[100].row.lang == "de" and by[None].held_out is False
    none = spark.createDataFrame([(1, "text", None, 1)], "doc_id long, text string, lang string, score int")
    assert identify(none).first().lang_pred == "und" and identify(none.limit(0)).collect() == []


def test_rates_use_whole_texts():
    model = fit({"a": ["abab" * 50], "b": ["cdcd" * 50]})
    r, _ = rates(["ab" * 300 + "cd" * 2000, "ab" * 3000 + "cd" * 200], model)
    assert r[0].argmin() == 1 and r[1].argmin() == 0


def test_letters_beyond_the_most_frequent_are_spelled():
    hanzi = [chr(0x4E00 + i) for i in range(3000)]
    model = fit({"x": ["".join(hanzi) + "abc" * 40]})
    seq, sizes, letters = symbols(["".join(hanzi), "abc", "\u0391"], model["letters"], model["width"])
    assert model["width"] == 3 and letters.tolist() == [3000, 3, 1] and sizes.tolist()[1:] == [4, 2]
    assert seq[-2] == OTHER and (seq < CLASSES).all()
    one, spelled, at = 0, set(), 0
    for c in hanzi:  # every letter has a spelling of its own
        word = tuple(symbols([c], model["letters"], model["width"])[0].tolist())
        spelled.add(word)
        one += len(word) == 2
        assert tuple(seq[at:at + len(word) - 1].tolist()) == word[:-1]
        at += len(word) - 1
    assert len(spelled) == 3000 and one == SINGLE - 3


def test_languages_of_one_large_script():
    rng = np.random.default_rng(3)
    words = {lang: ["".join(chr(0x4E00 + int(c)) for c in rng.integers(low, low + 2000, int(rng.integers(1, 4)))) for _ in range(600)]
             for lang, low in (("p", 0), ("q", 1000), ("r", 2000))}

    def text(lang, n):
        return "".join(rng.choice(words[lang], n))

    model = fit({lang: [text(lang, 300) for _ in range(40)] for lang in words})
    for k, lang in enumerate(sorted(words)):
        got, _ = rates([text(lang, 60) for _ in range(50)] + ["\u03b1\u03b2\u03b3" * 9], model)
        assert (got[:50].argmin(axis=1) == k).mean() >= 0.98
        assert (got[:50, k] <= 8).all() and (got[50] > 8).all()  # an alphabet that no sample has stays unknown


def test_many_scripts(spark):
    rng = np.random.default_rng(5)
    letters = {lang: [chr(low + i) for i in range(40)] for lang, low in (("ko", 0xAC00), ("am", 0x1200), ("el", 0x3B1), ("th", 0xE01), ("en", 0x61))}
    letters["en"], letters["el"] = letters["en"][:26], letters["el"][:24]
    rows = []
    for i in range(400):
        lang = list(letters)[i % 5]
        rows.append((i, " ".join("".join(rng.choice(letters[lang], 5)) for _ in range(20)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
