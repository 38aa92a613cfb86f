import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from creditloom.llm.token_counts import lengths_of, pre_tokens, processor, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", " a", "a ", "a  b", "a\nb", "\n", "\n\n a \n", "▁a▁ ▁", "<s> x</s><unk>", "\x00a\t\r\nb", "é é ﬁ 　", "🦙🦙 x",
         "word " * 3000, "x" * 5000, "ab<0x0A>"]


def test_counts_match_whole_text_encoding(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (90, None, "x"), (0, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # a clashing name
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, token_counts(docs, PATH, limit=100).collect()), key=str) == want
    assert sorted(map(tuple, token_counts(docs, PATH, limit=100, frequent=1).collect()), key=str) == want


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab ▁\n\t<s>é🦙\x00,.")), max_size=40))
def test_pre_tokens_add_up(text):
    sp = processor(PATH)
    assert sum(lengths_of(sp, pre_tokens(text))) == len(sp.encode(text))


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(Exception):
        processor(str(tmp_path / "none.model"))
