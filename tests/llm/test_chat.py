import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from creditloom.llm.chat import digests, escape, format_conversations, learned_texts, read_turns, render, token_mask, tokenizer, unescape

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = st.lists(st.sampled_from(["<", "|", "\\", "<|turn|>", "<|text|>", "<|end|>", "<|endoftext|>", "\n", " ", "a", "é", "🦙", "</s>[INST]"]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES, st.booleans()), max_size=5))
def test_any_text_reads_back_from_text_and_from_tokens(parts):
    import numpy as np

    turns = [("assistant" if learn else "".join(role), "".join(text)) for role, text, learn in parts]
    shown, spans = render(turns, "assistant")
    assert read_turns(shown) == turns
    t = tokenizer(PATH)
    code = t.encode(shown, add_special_tokens=False)
    mask = token_mask(code.offsets, spans)
    assert learned_texts(t, np.array(code.ids), mask) == [x for r, x in turns if r == "assistant" and x]
    assert t.decode(code.ids, skip_special_tokens=False) == shown


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_escaping_is_reversible(parts):
    text = "".join(parts)
    assert unescape(escape(text)) == text and "<|" not in escape(text)


def test_digests(spark):
    convs = {1: [("user", "hi"), ("assistant", "<|end|> yes\n"), ("assistant", ""), (None, "x"), ("assistant", None), ("assistant", "é" * 50)],
             2: [("assistant", "only")], None: [("user", "no id"), ("assistant", "ok")], 5: [("user" if k % 2 else "assistant", f"turn {k} ") for k in range(700)]}
    rows = [(c, k, r, t, "x") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rows += [(9, None, "user", "first", "x"), (9, 0, "assistant", "b", "x"), (9, 0, "assistant", "a", "x"), (9, 0, "assistant", "a", "x")]
    convs[9] = [("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    for piece_chars in (1 << 20, 100):
        pieces = format_conversations(frame, PATH, piece_chars=piece_chars)
        got = {r.conv_id: r for r in digests(pieces, PATH).collect()}
        assert set(got) == set(convs)
        for c, turns in convs.items():
            turns = [(r or "", t or "") for r, t in turns]
            loss = "".join(t for r, t in turns if r == "assistant")
            r = got[c]
            assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert r.formatted_chars == len(render(turns, "assistant")[0])
        if piece_chars == 100:
            assert pieces.where("conv_id = 5").count() > 100
    assert digests(format_conversations(frame.limit(0), PATH), PATH).collect() == []


def test_pieces_have_the_tokens_of_the_whole(spark):
    turns = [(7, k, "assistant" if k % 2 else "user", f" <text {k}\n" * 3) for k in range(150)]
    rows = format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), PATH, piece_chars=400).orderBy("part", "piece").collect()
    whole, _ = render([(r, t) for _, _, r, t in turns], "assistant")
    assert "".join(r.formatted for r in rows) == whole
    assert [i for r in rows for i in r.tokens] == tokenizer(PATH).encode(whole, add_special_tokens=False).ids
