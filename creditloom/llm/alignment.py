"""Alignment of two tokenizers' tokens over a corpus, with corpus-wide link counts.

Offsets of bytes at which tokens of both tokenizers end cut a text into groups; the two tokens that
end there are linked. Most groups are one token on each side with the same bytes, and which token B
has for the bytes of one of A is known beforehand: the identity map. Such links are counted in a
vector as long as A's vocabulary. Only other links are counted as pairs. Texts are encoded once; their
links are kept as numbers in chunks, each with a list of its own irregular pairs, and only these
lists are shuffled, to be counted and to carry the totals back.

For each A token that ends a group, a link is stored as a number: A's id for a link of the identity map,
the size of A's vocabulary plus the place in the chunk's list for another. A document's numbers are u16
where all of them fit, else u32; how many there are tells which.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import IdCache, bytes_of, id_text, no_cycle_search, slices, worker_cache
from creditloom.operators.sizing import settings, settle

CHUNK_BYTES = 1 << 20
PIECE_BYTES = 1 << 19
CACHED = 150_000
# Rows are texts of up to 100 kB and chunks of a megabyte: Spark's batches of thousands of them would fill an executor.
SMALL_BATCHES = {"spark__sql__execution__arrow__maxBytesPerBatch": "4m", "spark__sql__parquet__columnarReaderBatchSize": "256"}
# How a byte-level tokenizer parts a text before merging, and the characters that are written out
# here as letters, numbers and white space. Texts with any other character are encoded whole.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\r "
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
SETTLED = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*")
SPACED_WORD = re.compile(f" [{_L}]+")

def byte_level_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 characters stand
    for themselves, the other bytes for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, their tokens' bytes and the identity map, built once per worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_level_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        usual = {}
        for i, raw in enumerate(self.b_bytes):
            if raw and not self.b.is_control(i) and not self.b.is_unknown(i) and (raw not in usual or self.b.is_byte(usual[raw])):
                usual[raw] = i
        self.same = np.array([usual.get(raw, -1) for raw in self.a_bytes], dtype=np.int64)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in all_of], dtype=np.int64) for all_of in (self.a_bytes, self.b_bytes))
        self.a_spaced = np.array([x.startswith(b" ") for x in self.a_bytes])
        if self.a.normalizer is not None or not {bytes([x]) for x in range(256)} <= set(self.a_bytes):
            raise ValueError("tokens of this tokenizer may lose bytes of a text")
        self.known = IdCache(self._a_parts, CACHED)
        probe = " It's  1st\n\n a-b, x?! \t'll we'll  "
        if np.concatenate(self.known.rows([PRE_TOKEN.findall(probe)])).tolist() != self.a.encode(probe, add_special_tokens=False).ids:
            raise ValueError("this tokenizer does not part texts as expected")
        self.a_text, self.b_text = self._texts(len(self.a_bytes), ",|"), self._texts(len(self.b_bytes), ",;")

    @staticmethod
    def _texts(n: int, ends: str) -> np.ndarray:
        """Each id in decimal, followed by either sign."""
        return np.array([[f"{i}{end}" for end in ends] for i in range(n)], dtype=object)

    def _a_parts(self, parts: list[str]) -> list[bytes]:
        """A's ids of pre-tokens. Words behind a space are encoded in one go: a word starts where a token does
        that starts with a space."""
        out = {}
        words = [x for x in parts if SPACED_WORD.fullmatch(x)]
        if words:
            ids = np.array(self.a.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, cuts = ids.tobytes(), [*(4 * np.nonzero(self.a_spaced[ids])[0]).tolist(), 4 * len(ids)]
            if len(cuts) != len(words) + 1 or cuts[0] != 0:
                raise ValueError("this tokenizer does not part texts as expected")
            out = {w: raw[x:y] for w, x, y in zip(words, cuts, cuts[1:])}
        rest = [x for x in parts if x not in out]
        if rest:
            out.update((x, struct.pack(f"<{len(e)}I", *e.ids)) for x, e in zip(rest, self.a.encode_batch_fast(rest, add_special_tokens=False)))
        return [out[x] for x in parts]

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """A's ids of whole texts. Its pre-tokens are encoded each by itself, and met again in a cache."""
        usual = [bool(SETTLED.fullmatch(t)) for t in texts]
        quick = iter(self.known.rows([PRE_TOKEN.findall(t) for t, ok in zip(texts, usual) if ok]))
        rest = [t for t, ok in zip(texts, usual) if not ok]
        slow = iter(self.a.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        return [next(quick).astype(np.int64) if ok else np.array(next(slow).ids, dtype=np.int64) for ok in usual]

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none where the bytes do not come out alike."""
        whole = [t.decode() for t in texts]
        a_all = self.encode_a([" " + t for t in whole])
        b_all = self.b.encode(whole, num_threads=1)
        none = np.zeros(0, dtype=np.int64)
        for raw, a, b in zip(texts, a_all, b_all):
            want = b" " + raw
            # A keeps every byte, as was checked when it was loaded.
            ok = raw and self.a_sizes[a].sum() == len(want) and b"".join(map(self.b_bytes.__getitem__, b)) == want
            yield (a, np.array(b, dtype=np.int64)) if ok else (none, none)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """The places of the A and B tokens that end a group, and all groups as text."""
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        at = np.searchsorted(b_ends, a_ends)
        a_last = np.nonzero(b_ends[np.minimum(at, len(b) - 1)] == a_ends)[0] if len(b) else np.zeros(0, dtype=np.int64)
        b_last = at[a_last]
        # In the text, a group's A tokens stand before its B tokens.
        a_closes, b_closes = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_closes[a_last], b_closes[b_last] = 1, 1
        a_group, b_group = np.cumsum(a_closes) - a_closes, np.cumsum(b_closes) - b_closes
        b_before, a_before = np.concatenate(([0], b_last + 1)), np.append(a_last + 1, len(a))
        out = np.empty(len(a) + len(b), dtype=object)
        out[np.arange(len(a)) + b_before[a_group]] = self.a_text[a, a_closes]
        out[np.arange(len(b)) + a_before[b_group]] = self.b_text[b, b_closes]
        return a_last, b_last, "".join(out.tolist())[:-1]


def pair(a_path: str, b_path: str) -> Pair:
    cache = worker_cache("token pairs")
    if (a_path, b_path) not in cache:
        cache[a_path, b_path] = Pair(a_path, b_path)
    return cache[a_path, b_path]


class Chunk:
    """Documents of a chunk with their links, and its irregular pairs with their counts."""

    def __init__(self):
        self.rows, self.links, self.places, self.counts, self.size = [], [], {}, [], 0

    def add(self, p: Pair, doc_id: int | None, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Takes a document; returns the A ids of its links in the identity map."""
        a_last, b_last, text = p.groups(a, b)
        left, right = a[a_last], b[b_last]
        codes, odd = left.copy(), p.same[left] != right
        pairs, where, n = np.unique(left[odd] << 32 | right[odd], return_inverse=True, return_counts=True)
        numbers = []
        for key, count in zip(pairs.tolist(), n.tolist()):
            k = self.places.setdefault(key, len(self.counts))
            if k == len(self.counts):
                self.counts.append(0)
            self.counts[k] += count
            numbers.append(k)
        codes[odd] = len(p.a_bytes) + np.array(numbers, dtype=np.int64)[where]
        sha = hashlib.sha256(text.encode()).hexdigest() if len(a) else ""
        self.rows.append((doc_id, len(a), len(b), len(a_last), sha))
        self.links.append(codes.astype("<u2" if codes.max(initial=0) < 1 << 16 else "<u4").tobytes())
        return left[~odd]


_CHUNK = ("chunk long, docs array<struct<doc_id:long, n_a:long, n_b:long, n_groups:long, groups_sha256:string>>, "
          "links array<binary>, a array<int>, b array<int>, n array<long>, same array<struct<a:int, n:long>>")


def linked_chunks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Chunks of encoded documents; a task's last row has its vector of identity links in ``same``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, first = pair(a_path, b_path), TaskContext.get().partitionId() << 32
        vector = np.zeros(len(p.a_bytes), dtype=np.int64)
        chunk, number = Chunk(), 0
        types = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), (
            "n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]))), ("links", pa.list_(pa.binary())), ("a", pa.list_(pa.int32())),
            ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("same", pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int64())])))])

        def close(same=()):
            names = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
            keys = np.array(list(chunk.places), dtype=np.int64)
            row = [first + number, [dict(zip(names, r)) for r in chunk.rows], chunk.links, (keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(),
                   chunk.counts, [{"a": a, "n": n} for a, n in same]]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, types)], schema=types)

        for piece in slices(batches, most=min(PIECE_BYTES, chunk_bytes // 2)):
            raw = bytes_of(piece)
            with no_cycle_search():
                for doc_id, t, (a, b) in zip(piece.column("_id").to_pylist(), raw, p.encode(raw)):
                    regular = chunk.add(p, doc_id, a, b)
                    np.add.at(vector, regular, 1)
                    chunk.size += len(t)
            if chunk.size >= chunk_bytes:
                yield close()
                chunk, number = Chunk(), number + 1
        some = np.nonzero(vector)[0]
        if chunk.rows or len(some):
            yield close(zip(some.tolist(), vector[some].tolist()))

    return id_text(docs, id_col, text_col).mapInArrow(run, _CHUNK)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A encodes a space and the text, B (which adds one) the text. ``n_links`` pairs of tokens end together,
    the last ones of each group. ``n_best`` of them have the highest count, over the whole corpus, that their B token
    has with any A token (ties included); ``count_sum`` adds the counts of all.

    Null and empty texts, and texts whose tokens do not give back a space and the text, have no tokens: zeros
    and an empty string. Repeated rows and null ids are kept as they are. Other columns are ignored. An empty table
    gives an empty one. Vectors and each B token's best count are as long as a vocabulary and travel whole; pairs are
    joined.
    """
    with settings(docs.sparkSession, **SMALL_BATCHES):
        return settle(_aligned(docs, a_path, b_path, id_col, text_col, chunk_bytes))


def _aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    chunks = settle(linked_chunks(docs, a_path, b_path, id_col, text_col, chunk_bytes))
    p = pair(a_path, b_path)
    size_a, same_b = len(p.a_bytes), p.same
    found = chunks.select(F.explode("same").alias("x")).groupBy("x.a").agg(F.sum("x.n").alias("n")).collect()
    vector = np.zeros(size_a, dtype=np.int64)
    vector[[r.a for r in found]] = [r.n for r in found]

    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "x")).select("chunk", "at", "x.*")
    pairs = settle(listed.groupBy("a", "b").agg(F.sum("n").alias("total")))
    best = np.zeros(len(p.b_bytes), dtype=np.int64)
    np.maximum.at(best, same_b[same_b >= 0], vector[same_b >= 0])
    for r in pairs.groupBy("b").agg(F.max("total").alias("n")).collect():
        best[r.b] = max(best[r.b], r.n)
    totals = listed.join(pairs, ["a", "b"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "b", "total")).alias("totals"))
    known = docs.sparkSession.sparkContext.broadcast((vector, best, same_b))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, best, same_b = known.value
        is_best = np.zeros(len(vector), dtype=bool)
        is_best[same_b >= 0] = vector[same_b >= 0] == best[same_b[same_b >= 0]]
        for batch in batches:
            for rows, links, totals in zip(batch.column("docs"), batch.column("links"), batch.column("totals")):
                more = 0 if totals.as_py() is None else len(totals.values)
                counts, top = np.concatenate((vector, np.zeros(more, dtype=np.int64))), np.concatenate((is_best, np.zeros(more, dtype=bool)))
                if more:
                    at, b, total = (totals.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "b", "total"))
                    counts[len(vector) + at], top[len(vector) + at] = total, total == best[b]
                held = zip(links.values, rows.values.field("n_groups").to_pylist()) if len(links) else ()
                codes = [np.frombuffer(x.as_buffer(), dtype="<u2" if len(x.as_buffer()) == 2 * n else "<u4") for x, n in held]
                n_links, n_best, sums = ([int(f(c)) for c in codes] for f in (len, lambda c: top[c].sum(), lambda c: counts[c].sum()))
                docs = rows.values
                arrays = [docs.field("doc_id"), docs.field("n_a"), docs.field("n_b"), docs.field("n_groups"), pa.array(n_links, pa.int64()),
                          pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), docs.field("groups_sha256")]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    joined = chunks.select("chunk", "docs", "links").join(totals, "chunk", "left").select("docs", "links", "totals")
    return joined.mapInArrow(count, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
