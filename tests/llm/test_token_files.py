import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditloom.llm.common import IdCache, release_caches, worker_cache
from creditloom.llm.files import read_files, run_folder
from creditloom.llm.queries import token_file_digests
from creditloom.llm.token_files import CLOSING, encode_texts, encode_words, letter_tokenizers, open_shard, read_frame, read_tokens, tokenizer, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
TEXTS = ["", "Hello, World. It's 1,234.5!", "<|endoftext|>A<|ENDOFTEXT|> b", "É é ǅ İ K ﬁ", "a\x1cb\x85c d e", "x" * 3000, "word, " * 2000,
         "a.,b ,c. ..", "\n\t ", "don't we're I'LL", "日本語 テキスト。", "\x00 ."]


def ids(text, end=2):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [end]


def test_round_trip_and_starts(spark):
    rows = [(len(TEXTS) - i, t, "s") for i, t in enumerate(TEXTS)] + [(77, None, "s"), (77, "tie", "s"), (None, "no id", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted(map(tuple, token_file_digests(docs, run_folder(spark, "t")).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    at = 0
    for g, (i, t, _) in zip(got, order, strict=True):
        e = ids(t)
        assert g == (i, at, len(e), zlib.crc32(np.array(e, dtype="<u4").tobytes()))
        at += len(e)


def test_files_are_seekable_zstandard(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    folder = run_folder(spark, "t")
    write_tokens(docs, folder, PATH, shard_bytes_most=400)
    shards = [bytes(r.content) for r in read_files(spark, folder).collect()]
    assert len(shards) > 5
    parsed = sorted((open_shard(x)[:2], x) for x in shards)
    whole = b""
    for _, data in parsed:
        assert data.endswith(CLOSING)
        reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
        whole += reader.read()
    assert whole == b"".join(np.array(ids(f"text number {i} " * (i % 7)), dtype="<u4").tobytes() for i in range(300))
    some = {r.doc_id: bytes(r.tokens) for r in read_tokens(spark, folder, [5, 299, 4000]).collect()}
    assert some == {i: np.array(ids(f"text number {i} " * (i % 7)), dtype="<u4").tobytes() for i in (5, 299)}


def test_damage_is_noticed(spark):
    folder = run_folder(spark, "t")
    write_tokens(spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string"), folder, PATH)
    data = bytes(read_files(spark, folder).first().content)
    table = open_shard(data)[3]
    at = int(table[1, 0])
    broken = data[:at + 8] + bytes([data[at + 8] ^ 1]) + data[at + 9:]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        read_frame(broken, table[1])
    with pytest.raises(ValueError):
        open_shard(data[:-1])


def test_empty_table(spark):
    assert token_file_digests(spark.createDataFrame([], "doc_id long, text string"), run_folder(spark, "t")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abZ'st,.<|> \n\té́É1🦙")) | st.characters(codec="utf-8"), max_size=40))
def test_words_one_by_one(text):
    first, second = encode_texts(IdCache(lambda words: encode_words(tokenizer(PATH), words), 10), [text.encode(), b"x. " + text.encode()])
    assert np.frombuffer(second, dtype="<u4").tolist() == WHOLE.encode("x. " + text, add_special_tokens=False).ids
    assert np.frombuffer(first, dtype="<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_id_cache_forgets_between_texts_only():
    made = []
    cache = IdCache(lambda keys: made.extend(keys) or [bytes([len(k), 0, 0, 0]) * len(k) for k in keys], 2)
    for _ in range(2):
        got = cache.rows([["a", "bbb", ""], [], ["cc", "a"]])
        assert [x.tolist() for x in got] == [[1, 3, 3, 3], [], [2, 2, 1]]
    assert made == ["a", "bbb", "", "cc"] * 2
    assert cache.rows([["a"]])[0].tolist() == [1] and cache.known("a") == b"\x01\0\0\0" and cache.known("no") is None


def test_new_words_take_short_ways():
    """Signs at a word's end are encoded once, and lower-case Latin words without normaliser and pattern."""
    t, asked = tokenizer(PATH), []

    class Counted:
        def __getattr__(self, name):
            return getattr(t, name)

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return t.encode_batch_fast(texts, **more)

    words = ["heat***", "heat", "re%%%", "re?!", "\u00e9\u00df),", "\u00e9\u00df", "n\u00e4h.", "\u0130,", "\u0958.", "it's", "'s.", "2$$$", "\u00c8.", "a\u0301!", "***"]
    assert encode_words(Counted(), [w.encode() for w in words]) == [np.array(ids(w)[:-1], dtype="<u4").tobytes() for w in words]
    assert all(x is not t for x in letter_tokenizers(t))
    assert not any(c in " ".join(asked).split() for c in ("heat", "heat***", "re", "re%%%", "re?!", "\u00e9\u00df", "\u00e9\u00df),"))


def test_later_stages_release_the_caches():
    """The word ids of one stage do not stay in the worker beside the next stage's work."""
    gone, kept = IdCache(lambda words: [b"" for _ in words], 10), IdCache(lambda words: [b"" for _ in words], 10)
    worker_cache("test words")["a"], worker_cache("test kept")["b"] = gone, kept
    there = weakref.ref(gone)
    del gone
    release_caches("test kept", "tokenizers", "word ends", "letter tokenizers", "word ids")
    assert there() is None and worker_cache("test kept")["b"] is kept and not worker_cache("test words")
    release_caches()
    assert not worker_cache("tokenizers") and not worker_cache("test kept")
    assert encode_texts(IdCache(lambda words: encode_words(tokenizer(PATH), words), 10), [b"heat."])[0] == np.array(ids("heat.")[:-1], dtype="<u4").tobytes()
