"""Token counts of whole texts by a two-tier lookup inside the scan.

A sentencepiece vocabulary whose pieces never hold a word mark after another character and never a
line break can be counted piecewise: a text is cut before each run of word marks and at each line
break, and its count is the sum over these pre-tokens. The first tier is a broadcast table of the
lengths of frequent pre-tokens, the second a cache in each Python worker that encodes what it has
not met. Pre-tokens are never shuffled: only each task's summary of its most frequent ones is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import RecentCache, id_text, no_cycle_search, slices, texts_of, worker_cache

FREQUENT = 32_768
PER_TASK = 8_192
LONGEST_KEY = 64
CACHED = 300_000

_SLOW = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens as keys: one word mark is taken off the front, a line break stays."""
    if not text:
        return []
    if "  " in text or " \n" in text or "▁" in text or text[0] == " " or text[-1] == " ":
        found = _SLOW.findall(" " + text.replace("▁", " "))
        return [x[1:] if x[0] == " " else x for x in found]
    return text.replace("\n", " \n").split(" ")


def processor(model_path: str):
    """The tokenizer, loaded once per worker, after checking that counts add up over pre-tokens."""
    cache = worker_cache("sentencepiece")
    if model_path not in cache:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_byte(i))
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of this vocabulary crosses pre-tokens")
        if sp.encode("  a", out_type=str) != ["▁▁", "▁a"]:
            raise ValueError("this vocabulary changes white space")
        cache[model_path] = sp
    return cache[model_path]


def lengths_of(sp, keys: list[str]) -> list[int]:
    """Token counts of pre-tokens; a key with a line break carries the dummy mark before it."""
    out = [len(ids) for ids in sp.encode(keys, num_threads=1)]
    return [1 if not k else n - 1 if k[0] == "\n" else n for k, n in zip(keys, out)]


def frequent_lengths(docs: DataFrame, text_col: str, model_path: str, frequent: int = FREQUENT,
                     per_task: int = PER_TASK) -> dict[str, int]:
    """The most frequent pre-tokens of all texts with their lengths, at most ``frequent`` of them.

    Each task sends at most ``per_task`` pre-tokens with counts, which are added up. The table only
    saves work; counts of tokens do not depend on it.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches):
            with no_cycle_search():
                for text in texts_of(part):
                    seen.update(pre_tokens(text))
            if len(seen) > 16 * per_task:
                seen = Counter(dict(seen.most_common(4 * per_task)))
        top = [(k, n) for k, n in seen.most_common(per_task) if len(k) <= LONGEST_KEY]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()),
                                          pa.array([n for _, n in top], pa.int64())], ["key", "n"])

    found = (docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(summary, "key string, n long")
             .groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(frequent))
    keys = [r.key for r in found.collect()]
    return dict(zip(keys, lengths_of(processor(model_path), keys))) if keys else {}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids are kept as they
    are. Other columns are ignored. An empty table gives an empty one.
    """
    first = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text_col, model_path, frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, frequent_ones = processor(model_path), first.value
        recent = worker_cache("lengths").setdefault(model_path, RecentCache(CACHED, LONGEST_KEY))
        for part in slices(batches):
            sizes, counts = [], []
            with no_cycle_search():
                for text in texts_of(part):
                    keys = pre_tokens(text)
                    got = list(map(frequent_ones.get, keys))
                    total = sum(filter(None, got))
                    if None in got:
                        rest = [k for k, n in zip(keys, got) if n is None]
                        total += sum(recent.look_up(rest, lambda missed: lengths_of(sp, missed)))
                    sizes.append(len(text.encode()))
                    counts.append(total)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                                              pa.array([n > limit for n in counts], pa.bool_())],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
