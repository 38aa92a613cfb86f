import hashlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from creditloom.llm.alignment import SMALL_BATCHES, Chunk, align, linked_chunks, pair
from creditloom.operators.sizing import settings

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["", "a", " a", "The cat sat on the mat, didn't it?", "a\nb\n\n  c", "<|endoftext|> and <s> </s>", "▁mark", "é ü ﬁ 🦙🦙 xyz\x00\t", "　wide",
         "word " * 3000, "x" * 4000, "ab<0x0A>", "Unbelievable tokenization of indivisibilities", "12345 67.890", " ", "   "]


def tables():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown}
    for x in range(256):
        if x not in shown:
            byte[chr(256 + len(byte) - len(shown))] = x
    a_bytes = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def brute(rows):
    a, b, a_bytes, b_bytes = tables()
    docs, counts = [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        want = b" " + (text or "").encode()
        if not text or b"".join(map(a_bytes, ids_a)) != want or b"".join(map(b_bytes, ids_b)) != want:
            docs.append((i, 0, 0, [], []))
            continue
        groups, links, ga, gb, na, nb, todo = [], [], [], [], 0, 0, list(ids_b)
        for x in ids_a:
            ga.append(x)
            na += len(a_bytes(x))
            while todo and nb + len(b_bytes(todo[0])) <= na:
                nb += len(b_bytes(todo[0]))
                gb.append(todo.pop(0))
                if nb == na:
                    break
            if na == nb:
                links.append((x, gb[-1]))
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        assert not ga and not gb and not todo
        counts.update(links)
        docs.append((i, len(ids_a), len(ids_b), links, groups))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return [(i, na, nb, len(g), len(li), sum(counts[x] == best[x[1]] for x in li), sum(counts[x] for x in li),
             hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for i, na, nb, li, g in docs]


def test_against_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id at all", 2), (90, None, 3), (0, "The cat", 4), (0, "The cat", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(3)  # a clashing name
    want = sorted(brute([r[:2] for r in rows]), key=str)
    assert sum(r[4] > 0 for r in want) > 12 and any(r[5] < r[4] for r in want)
    for size in (2 << 20, 40):
        assert sorted(map(tuple, align(docs, A, B, chunk_bytes=size).collect()), key=str) == want


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, align(docs, A, B).collect())) == sorted(want)


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_identity_map_names_tokens_of_the_same_bytes():
    p = pair(A, B)
    mapped = [(i, j) for i, j in enumerate(p.same.tolist()) if j >= 0]
    assert len(mapped) > 10000
    assert all(p.a_bytes[i] == p.b_bytes[j] for i, j in mapped)


def test_pre_tokens_give_the_ids_of_whole_texts():
    p = pair(A, B)
    texts = [" " + t for t in TEXTS] + [" é Ü ñ'll x's 'S\n \t  12a  ", " ƀɏ ʰ", "\u00a0\x85 \x1c x", " ²½ º ª", "\u3000a"] * 2
    assert [x.tolist() for x in p.encode_a(texts)] == [p.a.encode(t, add_special_tokens=False).ids for t in texts]
    settled = "".join(map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]))
    for i in range(0, len(settled)):
        t = f" x{settled[i]}y{settled[i]} {settled[i]}{settled[i]}9 {settled[i]}"
        assert p.encode_a([t])[0].tolist() == p.a.encode(t, add_special_tokens=False).ids


def test_links_take_two_bytes_where_their_numbers_fit(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat."), (2, "")], "doc_id long, text string").coalesce(1)
    chunk = linked_chunks(docs, A, B, "doc_id", "text", 1 << 20).first()
    assert [len(x) for x in chunk.links] == [2 * d.n_groups for d in chunk.docs] and chunk.docs[0].n_groups > 5


def test_numbers_beyond_two_bytes_keep_four():
    n = 20_000
    p = SimpleNamespace(a_bytes=[b""] * 50_000, same=np.full(50_000, -1), groups=lambda a, b: (np.arange(n), np.arange(n), "x"))
    chunk, a = Chunk(), np.arange(n)
    chunk.add(p, 1, a, a)
    chunk.add(p, 2, a, a)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in chunk.links] == [list(range(50_000, 70_000))] * 2


def test_batches_are_small_and_settings_come_back(spark):
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(x) for x in names]
    with settings(spark, **SMALL_BATCHES):
        sizes = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) as t").mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) < 5 << 20 and sum(r.n for r in sizes) > 20_000_000
    align(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), A, B).collect()
    assert [spark.conf.get(x) for x in names] == before
