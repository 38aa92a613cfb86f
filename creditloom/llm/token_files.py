"""Token ids in seekable zstandard files.

A shard is a row of independent zstandard frames, one per document, in ascending id order. A
skippable frame in front lists the documents, and the seek table of the zstandard seekable format
stands at the end: compressed size, size and checksum of every frame. A reader takes the sizes from
the table and decompresses only the frames of the documents asked for.

    skippable frame   partition u32, number u32, documents u64, ids i64 each, 1 byte each: id is null
    zstandard frame   ids of a document as little-endian u32, for each document
    skippable frame   per frame: compressed size, size, low half of XXH64 (u32 each);
                      frames u32, descriptor byte, closing number u32

Files are ordinary input for zstandard tools: decompressed whole they give all ids in order.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import IdCache, bytes_of, id_text, no_cycle_search, slices, worker_cache
from creditloom.llm.files import read_files, write_files
from creditloom.operators.scans import prefix_scan

# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_FRAME, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x80
CLOSING = (0x8F92EAB1).to_bytes(4, "little")

SHARD_BYTES = 8 << 20
CACHED = 600_000


# ASCII signs that a word's end may be cut off at: no apostrophe, which joins letters, and none of the special tokens' own.
MARKS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def tokenizer(path: str):
    """The tokenizer, loaded once per worker, after a check that words can be encoded one by one:
    white space parts tokens, ASCII case does not matter, and signs at a word's end are a piece of their own."""
    cache = worker_cache("tokenizers")
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        probe = "Ab's  <c \t1\n,d e, F's. g-H. \u00c9\u0301x. i*** 2$$$ \u00e9\u00df), it's?! \u00c8. j<k>."
        whole = t.encode(probe, add_special_tokens=False).ids
        special = "".join(x.content for x in t.get_added_tokens_decoder().values()).encode()
        if np.array(whole, dtype="<u4").tobytes() != b"".join(encode_words(t, text_words(probe.encode()))) or set(special) & set(MARKS):
            raise ValueError("this tokenizer does not encode words one by one")
        cache[path] = t
    return cache[path]


def text_words(text: bytes) -> list[bytes]:
    """The words of a text in a form that many share; what may be a special token stays as it is."""
    return (text if b"<|" in text else text.lower()).split()


def parted(word: bytes) -> tuple[bytes, bytes]:
    """The word up to its last letter or digit, and the signs behind it. Beyond Latin-1 a letter may end
    in an accent, which belongs to the signs, when it is lower-cased or normalised: such words stay whole."""
    stem = word.rstrip(MARKS)
    if len(stem) == len(word) or not (stem[-1:].isalnum() or stem[-1:] > b"\x7f" and LATIN.match(stem.decode()[-1])):
        return word, b""
    return stem, word[len(stem):]


def encode_words(t, words: list[bytes], known: Callable[[bytes], bytes | None] | None = None) -> list[bytes]:
    """Ids of each word as little-endian u32; ``known`` may give those of some stems.

    Signs at a word's end are encoded apart. Words of letters alone are encoded in one go, as each of
    them ends at the next token that ends a word; lower-case ones of the Latin alphabet without the steps that leave them as
    they are (``letter_tokenizers``). Should the count not come out (a letter may turn into two), and for all other
    words, each word is encoded by itself.
    """
    parts = [parted(w) for w in words]
    found = {b"": b""}
    if known:
        found.update((s, ids) for s in {s for s, e in parts if e} if (ids := known(s)) is not None)
    rest = [w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in found]
    ascii_only = [w for w in rest if w.isalpha() and w.islower()]
    texts = {w: w.decode() for w in rest if not (w.isalpha() and w.islower())}
    latin = [w for w, x in texts.items() if LATIN.fullmatch(x)]
    others = [w for w, x in texts.items() if x.isalpha() and not LATIN.fullmatch(x)]
    for encoder, plain in zip((*letter_tokenizers(t), t), (ascii_only, latin, others)):
        if plain:
            ids = np.array(encoder.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.nonzero(word_ends(t)[ids])[0] + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                found.update((w, raw[a:b]) for w, a, b in zip(plain, cuts, cuts[1:]))
    rest = [w for w in rest if w not in found]
    if rest:
        for w, e in zip(rest, t.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            found[w] = struct.pack(f"<{len(e)}I", *e.ids)
    return [found[s] + found[e] if e else found[s] for s, e in parts]


def letter_tokenizers(t) -> tuple:
    """Tokenizers of the same model for lower-case words of ASCII and of Latin-1 letters alone: no normaliser or pattern
    changes or cuts these. Where a trial shows that the whole tokenizer does something else, it is taken itself."""
    cache = worker_cache("letter tokenizers")
    if id(t) not in cache:
        from tokenizers import Tokenizer, pre_tokenizers

        blanks, as_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x61, 0x100) if LATIN.fullmatch(chr(c))]
        out = []
        for split, own in ((blanks, letters[:26]), (pre_tokenizers.Sequence([blanks, as_bytes]), letters)):
            fast, trial = Tokenizer(t.model), " ".join([*own, "".join(own), *map("".join, zip(own, own[1:], own[2:]))])
            fast.pre_tokenizer = split
            same = fast.encode(trial, add_special_tokens=False).ids == t.encode(trial, add_special_tokens=False).ids
            out.append(fast if same else t)
        cache[id(t)] = tuple(out)
    return cache[id(t)]


def word_ends(t) -> np.ndarray:
    """Which ids are tokens that end a word."""
    cache = worker_cache("word ends")
    if id(t) not in cache:
        table = np.zeros(t.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in t.get_vocab(with_added_tokens=True).items():
            table[i] = token.endswith("</w>")
        cache[id(t)] = table
    return cache[id(t)]


def word_ids(path: str) -> IdCache:
    """Ids of the words met lately, kept in the worker; new words of several texts are encoded at once."""
    cache = worker_cache("word ids")
    if path not in cache:
        t = tokenizer(path)
        cache[path] = IdCache(lambda words: encode_words(t, words, cache[path].known), CACHED)
    return cache[path]


def encode_texts(known: IdCache, texts: list[bytes]) -> list[bytes]:
    """Ids of whole texts as little-endian u32."""
    return [ids.tobytes() for ids in known.rows([text_words(text) for text in texts])]


def shard_bytes(part: int, number: int, ids: list[int | None], frames: list[bytes], sizes: list[int], sums: list[int]) -> bytes:
    """A shard without its closing number."""
    head = struct.pack("<IIQ", part, number, len(ids))
    head += np.array([i or 0 for i in ids], dtype="<i8").tobytes() + bytes(i is None for i in ids)
    head = struct.pack("<II", SKIPPABLE, len(head)) + head
    table = np.array([[len(head), 0, EMPTY_SUM], *zip(map(len, frames), sizes, sums)], dtype="<u4").tobytes()
    footer = struct.pack("<IB", len(frames) + 1, CHECKSUMS)
    return b"".join([head, *frames, struct.pack("<II", SEEK_FRAME, len(table) + len(footer) + 4), table, footer])


EMPTY_SUM = 0x51D8E999  # low half of XXH64 of nothing


def open_shard(data: bytes) -> tuple[int, int, list[int | None], np.ndarray]:
    """Partition, number, document ids and the seek table with an offset column in front."""
    count, flags = struct.unpack_from("<IB", data, len(data) - 9)
    if data[-4:] != CLOSING or flags != CHECKSUMS:
        raise ValueError("not a shard: the closing number or its checksums are missing")
    table = np.frombuffer(data, dtype="<u4", count=3 * count, offset=len(data) - 9 - 12 * count).reshape(-1, 3).astype(np.int64)
    offsets = np.cumsum(table[:, 0]) - table[:, 0]
    part, number, n = struct.unpack_from("<IIQ", data, 8)
    ids = np.frombuffer(data, dtype="<i8", count=n, offset=24).tolist()
    nulls = data[24 + 8 * n: 24 + 9 * n]
    return part, number, [None if x else i for i, x in zip(ids, nulls)], np.column_stack((offsets, table))


def read_frame(data: bytes, row: np.ndarray) -> bytes:
    """One document's ids, checked against the seek table."""
    import xxhash
    import zstandard

    at, packed, size, wanted = row.tolist()
    out = zstandard.ZstdDecompressor().decompress(memoryview(data)[at: at + packed], max_output_size=size) if size else b""
    if len(out) != size or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != wanted:
        raise ValueError("a frame does not match its checksum")
    return out


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, id_col: str = "doc_id",
                 text_col: str = "text", shard_bytes_most: int = SHARD_BYTES, level: int = 1) -> None:
    """Encode every text, append ``end_id`` and write shards in ascending id order.

    Null texts count as empty. Rows with equal ids follow each other ordered by text; null ids come
    last. A document never spans frames or shards, so a shard may exceed ``shard_bytes_most`` by one
    document. An empty table writes no shard. Other columns are ignored.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        known = word_ids(path)
        pack = zstandard.ZstdCompressor(level=level)
        part, number = TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        ids, frames, sizes, sums, held = [], [], [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([shard_bytes(part, number, ids, frames, sizes, sums)], pa.binary())], ["shard"])

        for piece in slices(batches):
            with no_cycle_search():
                encoded = [raw + end for raw in encode_texts(known, bytes_of(piece))]
            for i, raw in zip(piece.column("_id").to_pylist(), encoded):
                frame = pack.compress(raw)
                ids.append(i)
                frames.append(frame)
                sizes.append(len(raw))
                sums.append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
                held += len(frame)
                if held >= shard_bytes_most:
                    yield full()
                    number += 1
                    ids, frames, sizes, sums, held = [], [], [], [], 0
        if ids:
            yield full()

    ordered = id_text(docs, id_col, text_col)
    order = F.col("_id").asc_nulls_last()
    write_files(ordered.repartitionByRange(order).sortWithinPartitions(order, "_text").mapInArrow(shards, "shard binary"),
                "shard", folder, CLOSING)


def read_tokens(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """``part, shard, position, doc_id, tokens`` (ids as little-endian u32) of all documents, or of
    those in ``wanted``: only their frames are decompressed and checked."""
    asked = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer().to_pybytes()
                part, number, ids, table = open_shard(data)
                rows, held = [], 0
                for k, i in enumerate(ids):
                    if asked is None or i in asked:
                        rows.append((part, number, k, i, read_frame(data, table[k + 1])))
                        held += len(rows[-1][4])
                    if rows and (held > SHARD_BYTES or k == len(ids) - 1):
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          ["part", "shard", "position", "doc_id", "tokens"])

    return read_files(spark, folder).select("content").mapInArrow(run, "part int, shard int, position long, doc_id long, tokens binary")


def with_starts(digests: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before, to rows with ``part, shard, position,
    n_tokens``. Totals of shards are scanned, then documents within each shard."""
    totals = digests.groupBy("part", "shard").agg(F.sum("n_tokens").alias("_n"))
    offsets = prefix_scan(totals, [], "part", ["shard"], {"_offset": ("sum", F.col("_n"), False)}).select("part", "shard", "_offset")
    inside = prefix_scan(digests, ["part"], "shard", ["position"], {"_before": ("sum", F.col("n_tokens"), False)})
    first = offsets.groupBy("part").agg(F.min("_offset").alias("_offset"))
    return inside.join(first, "part").withColumn("start", F.col("_offset") + F.col("_before")).drop("_offset", "_before")
