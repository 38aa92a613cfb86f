import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from creditloom.llm.mixing import mix
from creditloom.operators.sizing import settle

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_files"]


def test_run_on_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in pipeline.STAGES:
        before, docs = docs, settle(f(spark, docs, SF))
        if name != "token_files":
            assert docs.columns == pipeline.DOCUMENTS
    want = sorted(r.doc_id for r in before.select("doc_id").collect())
    got = sorted(map(tuple, docs.collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == want
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    assert [r[2] for r in got] == [sizes[i] for i in want]
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([sizes[i] for i in want])[:-1])).tolist()
    assert sorted(map(tuple, pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == got


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    vocab = [a + b + c for a in ("the", "an", "ver", "so") for b in ("do", "ri", "mel", "ta", "pon", "gu") for c in ("n", "st", "re", "ling", "k")]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(rng.choice(vocab, 150)) + ".", "en", f"s{i % 3}"))
    words = rows[4][1].split()
    words[70] = "changed"
    rows += [(50, rows[3][1], "en", "s0"), (51, " ".join(words), "en", "s1"), (52, "12 34 ...", "en", "s1"), (53, None, None, None), (54, "", "en", "s2")]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows.append((55, rows[7][1][:300] + " " + item + " " + rows[8][1][200:], "en", "s2"))
    rows += [(None, "a document without an id", "en", "s1"), (6, rows[6][1], "en", "s0")]
    return spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_decisions(spark, planted):
    kept = settle(stage("language_id")(spark, planted, SF))
    ids = [r.doc_id for r in kept.collect()]
    assert not {52, 53, 54} & set(ids) and None in ids and set(range(40)) <= set(ids)
    single = settle(stage("simhash_near_dedup")(spark, kept, SF))
    ids = [r.doc_id for r in single.collect()]
    assert not {50, 51} & set(ids) and None in ids and len(ids) == len(set(ids)) and set(range(40)) <= set(ids)
    clean = settle(stage("benchmark_decontamination")(spark, single, SF))
    ids = [r.doc_id for r in clean.collect()]
    assert 55 not in ids and set(range(40)) | {None} <= set(ids)
    mixed = [r.doc_id for r in stage("source_mixing")(spark, clean, SF).collect() if r.doc_id is not None]
    copies = {r.doc_id: r.copies for r in mix(clean).collect() if r.doc_id is not None}
    assert {i: mixed.count(i) for i in copies} == copies


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    vocab = np.array([f"v{i}" for i in range(500)])
    one, two, other = (" ".join(np.random.default_rng(k).choice(vocab, 120)) for k in (1, 2, 3))
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (1, two, "en", "r", 1), (2, two + " end", "en", "s", 1), (3, other, "en", "s", 1)]
    for n in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        got = stage("simhash_near_dedup")(spark, docs, SF).collect()
        assert {tuple(r) for r in got} == {rows[0], rows[2], rows[4]} and len(got) == 3


def test_mixing_keeps_rows_without_an_id_and_repeated_ids(spark):
    """Each source's words are what mix() counted, whatever the ids are."""
    rows = [(None, f"no id {'w ' * k}", None, f"s{k % 2}", None) for k in range(1, 30)]
    rows += [(7, "the same row", None, "s0", None)] * 3 + [(8, "one text", None, "s0", None), (8, "another text of this id", None, "s1", None)]
    rows += [(9, None, "a", "s1", None), (9, "a", None, "s1", None)] + [(100 + k, "w " * k, "en", "s2", k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out, judged = stage("source_mixing")(spark, docs, SF).collect(), mix(docs).collect()
    for i in {r[0] for r in rows}:
        assert sum(r.doc_id == i for r in out) == sum(r.copies for r in judged if r.doc_id == i)
    assert len(out) == sum(r.copies for r in judged) and sum(len((r.text or "").split()) for r in out) == sum(r.taken for r in judged)
    assert sum(r.doc_id is None for r in out) > 0 and {tuple(r) for r in out} <= set(rows)


def test_empty_table(spark, planted):
    docs = planted.limit(0)
    for _, f in pipeline.STAGES:
        docs = settle(f(spark, docs, SF))
        assert docs.count() == 0
