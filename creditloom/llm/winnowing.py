"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed by a polynomial; of each ``w`` consecutive hashes the
smallest is chosen, the rightmost of equals, and kept with its position. Any passage of at least
``w + k - 1`` code points that two texts share leaves a common hash in both; the positions tell
where. A text shorter than ``k`` counts as one run, the empty text has no hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import id_text, slices, texts_of
from creditloom.llm.words import mixed

K, WINDOW = 10, 10
BUCKETS = 2048
BUCKET_ROWS = 512
_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of the ``k`` numbers from each place on, scrambled. Runs are
    put together from runs of half the length, as a rolling hash adds one number at a time."""
    h, size, out, done = points.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = h.copy(), size
            else:
                tail = h[done: done + len(out)]
                out = out[: len(tail)] * np.uint64(pow(_BASE, size, 1 << 64)) + tail
                done += size
        if 2 * size > k:
            return mixed(out)
        h = h[: len(h) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2


def winnow(texts: list[str], k: int = K, w: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chosen hashes and their positions, in order, of each text."""
    import xxhash

    if not texts:
        return []
    pad = "\0" * (k + w)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(sizes + len(pad)) - sizes - len(pad)
    points = np.frombuffer((pad.join(texts) + pad + pad).encode("utf-32-le"), dtype="<u4")
    h = gram_hashes(points, k)
    inside = np.zeros(len(points) + 1, dtype=np.int64)  # places where a whole run lies in one text
    long_enough = sizes >= k
    np.add.at(inside, first[long_enough], 1)
    np.add.at(inside, first[long_enough] + sizes[long_enough] - k + 1, -1)
    valid = np.cumsum(inside)[: len(h)] > 0
    h = np.where(valid, h & ~np.uint64(1), _NONE)
    best, reach = np.arange(len(h)), 1
    while reach < w:
        step = min(reach, w - reach)
        right = best[step:]
        left = best[: len(right)]
        best = np.where(h[right] <= h[left], right, left)
        reach += step
    out = []
    for t, n, a in zip(texts, sizes.tolist(), first.tolist()):
        if n == 0:
            out.append((np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
        elif n < k:
            out.append((np.array([xxhash.xxh64_intdigest(t.encode())], dtype=np.uint64), np.zeros(1, dtype=np.int64)))
        else:
            chosen = best[a: a + max(1, n - k - w + 2)]
            chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
            out.append((h[chosen], chosen - a))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes as a part of all hashes (Jaccard); two texts without any are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def digest(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    hashes, positions = fingerprint
    return hashlib.sha256(hashes.astype("<u8").tobytes() + positions.astype("<i8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """``doc_id, hashes, positions`` per document. Null counts as the empty text; repeated rows and
    null ids stay; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = winnow(texts_of(part), k, w)
            yield pa.RecordBatch.from_arrays([
                part.column("_id"), pa.array([h.view(np.int64) for h, _ in got], pa.list_(pa.int64())),
                pa.array([p for _, p in got], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``_bucket, _copy, _id, _hash, _text`` in buckets of descending ids, so that within a
    bucket every own row (``_copy`` false) is followed by the next document.

    Bounds come from quantiles of the ids (at most BUCKETS). The first document of a bucket is also
    sent to the bucket before it, the first of all to the last. Each text is shuffled once. Null ids
    order last; equal ids by a hash of the text.
    """
    rows = id_text(docs, id_col, text_col).withColumns({
        "_key": F.coalesce("_id", F.lit(-(1 << 63))), "_hash": F.xxhash64(F.coalesce("_text", F.lit("")))})
    steps = [i / BUCKETS for i in range(1, BUCKETS)]
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("_key", F.array(*[F.lit(x) for x in steps]), 20 * BUCKETS)).first()
    every = max(1, BUCKETS * BUCKET_ROWS // max(1, n))
    bounds = sorted({float(x) for x in (cuts or [])[::every] if float(x) > -2.0**63}) or [0.0]
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_at", outputCol="_bucket")
    rows = cut.transform(rows.withColumn("_at", F.col("_key").cast("double"))).withColumn("_bucket", F.col("_bucket").cast("int"))
    heads = sorted(rows.groupBy("_bucket").agg(F.max(F.struct("_key", "_hash")).alias("_head")).collect(), reverse=True)
    follow = [(h["_head"]["_key"], h["_head"]["_hash"], heads[i - 1]["_bucket"]) for i, h in enumerate(heads)]
    copies = F.broadcast(docs.sparkSession.createDataFrame(follow, "_key long, _hash long, _also int"))
    homes = F.array_compact(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("c")),
                                    F.when(F.col("_also").isNotNull(), F.struct(F.col("_also").alias("b"), F.lit(True).alias("c")))))
    spread = rows.join(copies, ["_key", "_hash"], "left").withColumn("_home", F.explode(homes))
    return (spread.select(F.col("_home.b").alias("_bucket"), F.col("_home.c").alias("_copy"), "_id", "_key", "_hash", "_text")
            .repartition("_bucket").sortWithinPartitions("_bucket", "_copy", F.desc("_key"), F.desc("_hash"))
            .select("_bucket", "_copy", "_id", "_text"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """Each document against an edited form of itself and against the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; the
    edited text has its last third replaced by the beginning of the next document in descending
    id order (after the last comes the first; a single document is its own next). Fingerprints are
    given as digests of hashes and positions.
    """
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, is a copy, id, text, fingerprint of the row before
        for part in slices(batches, most=2 << 20):
            texts = texts_of(part)
            prints = winnow(texts, k, w)
            pairs = []
            for row in zip(part.column("_bucket").to_pylist(), part.column("_copy").to_pylist(), part.column("_id").to_pylist(), texts, prints):
                if last is not None and last[0] == row[0] and not last[1]:
                    cut = len(last[3]) // 3
                    pairs.append((last[2], last[3], last[4], last[3][: len(last[3]) - cut] + row[3][:cut], row[4]))
                last = row
            rows = [(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(new), likeness(own[0], new[0]), likeness(own[0], after[0]))
                    for (i, text, own, edited, after), new in zip(pairs, winnow([p[3] for p in pairs], k, w))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return with_next(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
