"""SimHash near-duplicates: whole-text fingerprints, exact radius search, connected groups.

Two fingerprints within radius 2 agree on at least two of any four groups of their bits, so all
pairs meet in buckets that share two groups. A bucket with too many distinct fingerprints is split
again by the same rule on the bits that are still free; 64 bits allow three such levels, after
which a bucket cannot hold more than 256 values. Within a bucket the comparison is bit-sliced:
bit planes stand vertically, one machine word holds a bit of 64 fingerprints, and distances are
counted for all of them at once with carry-save adders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import bytes_of, id_text, no_cycle_search, release_caches, slices
from creditloom.llm.graph import components
from creditloom.llm.words import mixed
from creditloom.operators.sizing import settle

SEED = 42
RADIUS = 2
BUCKET = 2048
BLOCK = 256


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the word shingles of a text; a shorter text is one shingle."""
    import xxhash

    w = text.lower().split()
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)] if w else []
    return np.array([digest(x, SEED) for x in shingles], dtype="<u8")


def majority(h: np.ndarray) -> np.ndarray:
    """The bits that more than half of the hashes (rows of 64-bit words) have; no hash: none."""
    ones = np.zeros(h.shape[1] * 64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(np.ascontiguousarray(h[at: at + (1 << 15)]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def text_fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of one text, as a signed number."""
    return int(majority(shingle_hashes(text, words)[:, None]).view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``_id, fp`` per document. A text without words, or null, has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            with no_cycle_search():
                fps = [text_fingerprint(t, words) for t in bytes_of(part)]
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(fps, pa.int64())], ["_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "_id long, fp long")


def refine(mask: int) -> list[int]:
    """The masks that fix, besides ``mask``, two of four groups of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = len(free) // 4
    groups = [sum(1 << b for b in free[i * n: (i + 1) * n]) for i in range(4)]
    return [mask | a | b for a, b in combinations(groups, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is greater than ``radius``."""
    more, level = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            level &= counters[k]
        else:
            more |= level & counters[k]
            level &= ~counters[k]
    return more


def near_blocks(values: np.ndarray, radius: int, asked: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of fingerprints (rows of 64-bit words) that differ in at most ``radius`` bits,
    some hundred i at a time and in their order; just those with i below ``asked``, if it is given."""
    n, planes_of = len(values), values.shape[1] * 64
    lanes = -(-n // 64) * 64
    bits = np.zeros((planes_of, lanes), dtype=np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(values).view(np.uint8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    later = np.arange(lanes)
    asked = n if asked is None else asked
    for at in range(0, asked, BLOCK):
        rows = np.arange(at, min(at + BLOCK, asked))
        ask = (np.uint64(0) - bits[:, rows].astype("<u8"))[:, :, None]
        first = at // 64  # only later lanes are asked for
        # A lane is lost once its counter is above the radius; earlier lanes and the own one start lost.
        lost = np.packbits((later[None, first * 64:] <= rows[:, None]) | (later[None, first * 64:] >= n), axis=1, bitorder="little").view("<u8")
        counters = [np.zeros_like(lost) for _ in range(max(1, radius.bit_length()))]
        for f in range(planes_of):
            carry = planes[f, first:][None, :] ^ ask[f]
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            lost |= carry
            if f % 8 == 7:
                lost |= _above(counters, radius)
                if (lost == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                    break
        else:
            i, j = np.nonzero(np.unpackbits((~lost).view(np.uint8), axis=1, bitorder="little"))
            yield i + at, j + first * 64


def within_radius(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of ``near_blocks``."""
    found = list(near_blocks(values, radius))
    return (np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def _spanning(values: np.ndarray, names: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each name to the first of its group: as few as keep every group connected."""
    i, j = within_radius(values, radius)
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(values)))[0]
    return names[moved], names[label[moved]]


def bucket_links(rows: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Links ``u, v`` between the names of fingerprints of the same bucket.

    ``rows`` has ``bucket`` (a struct), ``name`` and the fingerprint's ``words``. Buckets are read one
    after the other; neighbours are compared together in blocks, as any link found is a true one.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last, rest = 0, None, None

        def flush():
            both = np.unique(np.concatenate(held), axis=0)
            u, v = _spanning(both[:, 1:], both[:, 0].view(np.int64), radius)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([x.to_numpy() for x in batch.column("bucket").flatten()])
            value = np.column_stack([batch.column(c).to_numpy().view(np.uint64) for c in ("name", *words)])
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            new[0] = last is None or (key[0] != last).any()
            last = key[-1]
            if rest is not None:  # the last bucket of the batch before may go on here
                value, new = np.concatenate((rest, value)), np.concatenate(([True], np.zeros(len(rest) - 1, dtype=bool), new))
            cuts = np.append(np.nonzero(new)[0], len(value))
            rest = value[cuts[-2]:]
            sizes = np.diff(cuts[:-1])
            for a, n in zip(cuts[:-2][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                held.append(value[a: a + n])
                size += n
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if rest is not None and len(rest) > 1:
            held.append(rest)
        if held:
            yield flush()

    return (rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "name", *words)
            .mapInArrow(compare, "u long, v long"))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``u, v`` that connect all distinct fingerprints ``fp`` within radius 2 of each other."""

    # A finer mask may come from several coarser ones; it is taken once.
    level, masks, out = distinct.select("fp", F.lit(0).cast("long").alias("mask")), [0], None
    while True:
        finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in refine(m)]))])
        rows = (level.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
                .withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))
        sizes = settle(rows.groupBy("mask", "key").count().where("count > 1"))
        fit = rows.join(sizes.where(F.col("count") <= bucket).select("mask", "key"), ["mask", "key"], "left_semi")
        found = settle(bucket_links(fit.select(F.struct("mask", "key").alias("bucket"), F.col("fp").alias("name"), "fp"), ["fp"], RADIUS))
        out = found if out is None else out.union(found)
        over = sizes.where(F.col("count") > bucket).select("mask", "key")
        masks = list(dict.fromkeys(y for m in masks for y in refine(m)))
        if over.isEmpty():
            return out
        level = settle(rows.join(over, ["mask", "key"], "left_semi").select("fp", "mask").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document.

    Documents link when their fingerprints differ in at most two bits; ``component_id`` is the
    smallest id that can be reached over links, the document's own included. Equal fingerprints are
    compared once. Null ids keep their row and never name a component unless they are alone (then it
    is null). Null texts count as empty, empty texts share fingerprint zero. Repeated rows stay.
    """
    marked = settle(fingerprints(docs, id_col, text_col, words))
    distinct = settle(marked.groupBy("fp").agg(F.min("_id").alias("first")))
    group = components(links(distinct, bucket))
    roots = distinct.join(group, distinct["fp"] == group["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- Groups by similarity of five-word shingles, for stages that drop near copies.

WIDE_WORDS, WIDE_SIMILARITY, KEYS, KEY_BITS, WIDE_BUCKET = 5, 0.8, 80, 16, 4096
FEW, PIVOTS, BINS = 32, 64, 128
SHORT = 32


def wide_radius(similarity: float, bits: int = 128) -> int:
    """The distance that nearly all pairs of that Jaccard similarity keep: its mean, by the angle
    between shingle sets, and two standard deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * share + 2 * np.sqrt(bits * share * (1 - share))))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """128-bit SimHash of a set of hashes, sorted. Where as many hashes have a bit as lack it, the least
    hash decides, so that the fingerprints of short texts do not lean to zero."""
    both = np.column_stack((h, mixed(h)))
    return majority(both if len(h) % 2 else np.concatenate((both, both[:1])))


def _pick(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of fingerprints at ``places``, a row of places per key, as numbers."""
    out = np.zeros((len(words), len(places)), dtype=np.int64)
    for k in range(places.shape[1]):
        at = places[:, k]
        out |= (words[:, at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << k
    return out


def _not_met_before(a: np.ndarray, b: np.ndarray, way: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints agree on no key before ``way``: there each pair counts once."""
    x, keep = a ^ b, np.ones(len(a), dtype=bool)
    for k in range(min(int(way.max(initial=0)), len(masks))):
        keep &= (way <= k) | ((x & masks[k]) != 0).any(axis=1)
    return keep


def _bounded(hist: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs may reach the similarity: sets share at most the sum of the lesser counts per bin."""
    out = np.ones(len(i), dtype=bool)
    for at in range(0, len(i), 8192):
        a, b = hist[i[at: at + 8192]], hist[j[at: at + 8192]]
        most, total = np.minimum(a, b).sum(axis=1, dtype=np.int64), a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64)
        out[at: at + 8192] = most >= similarity * (total - most) - 1e-9
    return out


def bucket_pairs(rows: DataFrame, radius: int, similarity: float, masks: np.ndarray, final: bool) -> DataFrame:
    """Candidate pairs ``u, v`` within the radius in the same ``(way, key, a, b)``, whose sizes allow
    the similarity. Rows have ``own``, their block; where a and b differ, blocks are compared with
    each other only.

    At first (not ``final``) large buckets give for each row just its first partner in the order of
    names, and a row ``way, key, a, b`` without a pair that says more were there. ``final`` rows have
    ``comp`` and ``hist``: all pairs of different components are given that the histograms allow.
    """
    keys = ["way", "key", "a", "b"]

    def found(group: np.ndarray, start: np.ndarray, data: dict) -> Iterator[pa.RecordBatch]:
        fp = np.column_stack((data["f0"], data["f1"])).view(np.uint64)
        name, n, own, cross = data["node"], data["n"], data["own"], group[:, 2] != group[:, 3]
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(fp))))
        size = np.bincount(of)
        large = size > (0 if final else FEW)
        met, more, asked = np.zeros(len(fp), dtype=bool), np.zeros(len(start), dtype=bool), len(fp)
        if final:  # rows of the commonest component need not be compared with each other
            comps, at, count = np.unique(data["comp"], return_inverse=True, return_counts=True)
            order = np.argsort(at == count.argmax(), kind="stable")
            asked = len(fp) - int(count.max()) if len(start) == 1 else len(fp)
            if len(start) > 1:
                order = np.arange(len(fp))
            fp, name, n, own, of, at = (x[order] for x in (fp, name, n, own, of, at))
            hist = np.stack([np.frombuffer(x, dtype="<u4") if x is not None else np.zeros(BINS, dtype="<u4") for x in (data["hist"][k] for k in order)])
            blank = ~hist.any(axis=1)
        for i, j in near_blocks(fp, radius, asked):
            ok = (of[i] == of[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
            ok &= ~cross[of[i]] | (own[i] != own[j])
            if final:
                ok &= at[i] != at[j]
            i, j = i[ok], j[ok]
            if final:
                ok = _not_met_before(fp[i], fp[j], group[of[i], 0], masks)
                i, j = i[ok], j[ok]
                ok = _bounded(hist, i, j, similarity) | blank[i] | blank[j]
            else:
                ok = np.zeros(len(i), dtype=bool)
                many = np.nonzero(large[of[i]])[0]
                few = np.nonzero(~large[of[i]])[0]
                ok[few] = _not_met_before(fp[i[few]], fp[j[few]], group[of[i[few]], 0], masks)
                firsts = many[np.unique(j[many], return_index=True)[1]]
                firsts = firsts[~met[j[firsts]]]
                ok[firsts] = True
                met[j[firsts]] = True
                more[of[i[many[~ok[many]]]]] = True
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 1 << 16):
                u, v = name[j[s: s + (1 << 16)]], name[i[s: s + (1 << 16)]]
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none, none, none, none], ["u", "v", *keys])
        said = group[more]
        none = pa.nulls(len(said), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *(pa.array(said[:, k]) for k in range(4))], ["u", "v", *keys])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def buckets():
            """Whole buckets, as long as there are several rows: the key and the columns."""
            rest = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                table = table if rest is None else pa.concat_tables([rest, table])
                key = np.column_stack([table.column(c).to_numpy() for c in keys])
                last = int(np.nonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))[0][-1])
                if last:
                    yield key[:last], table.slice(0, last)
                rest = table.slice(last)
            if rest is not None:
                yield np.column_stack([rest.column(c).to_numpy() for c in keys]), rest

        release_caches()
        for key, table in buckets():
            start = np.nonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))[0]
            size = np.diff(np.append(start, len(key)))
            data = {c: table.column(c).to_numpy() for c in ("node", "f0", "f1", "n", "own", *(["comp"] if final else []))}
            if final:
                data["hist"] = np.array([*table.column("hist").to_pylist(), None], dtype=object)[:-1]
            held, rows_held = [], 0
            for k in np.nonzero(size > 1)[0].tolist() + [None]:
                alone = k is None or size[k] > BLOCK
                if held and (alone or rows_held + size[k] > BLOCK):
                    at = np.concatenate([np.arange(start[x], start[x] + size[x]) for x in held])
                    yield from found(key[start[held]], np.cumsum(size[held]) - size[held], {c: x[at] for c, x in data.items()})
                    held, rows_held = [], 0
                if k is None:
                    break
                held.append(k)
                rows_held += size[k]
                if alone:
                    at = slice(start[k], start[k] + size[k])
                    if not final or len(np.unique(data["comp"][at])) > 1:
                        yield from found(key[start[[k]]], np.zeros(1, dtype=np.int64), {c: x[at] for c, x in data.items()})
                    held, rows_held = [], 0

    extra = ["comp", "hist"] if final else []
    return (rows.select(*keys, "node", "f0", "f1", "n", "own", *extra).repartition(*keys).sortWithinPartitions(*keys, "node")
            .mapInArrow(compare, "u long, v long, way long, key long, a long, b long"))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose sets of hashes have at least that Jaccard similarity."""
    left, right = (sets.select(F.col("node").alias(x), F.col("h").alias(f"_{x}")) for x in ("u", "v"))
    both = F.size(F.array_intersect("_u", "_v"))
    return (pairs.join(right, "v").join(left, "u")
            .where(both >= similarity * (F.size("_u") + F.size("_v") - both) - 1e-9).select("u", "v"))


def rare_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """``way, key`` and the columns ``node, f0, f1, n`` of ``sets`` for each hash by which a set ``h`` can be met.

    Two sets of that Jaccard similarity share one of their first n - ceil(similarity * n) + 1 hashes in
    any order that all sets keep. Here hashes come first that few sets hold; those of up to ``FEW`` sets
    count as equally rare, so that only the common ones are joined.
    """
    each = sets.select("node", "f0", "f1", "n", F.explode("h").alias("key"))
    common = settle(each.groupBy("key").count().where(F.col("count") > FEW))
    ordered = (each.join(common, "key", "left").groupBy("node", "f0", "f1", "n")
               .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "key"))).alias("h")))
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    return (ordered.select(F.lit(0).cast("long").alias("way"), F.explode(F.slice("h", F.lit(1), first.cast("int"))).alias("x"), "node", "f0", "f1", "n")
            .select("way", "x.key", "node", "f0", "f1", "n"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WIDE_WORDS,
                   similarity: float = WIDE_SIMILARITY, keys: int = KEYS, key_bits: int = KEY_BITS, bucket: int = WIDE_BUCKET,
                   short: int = SHORT) -> DataFrame:
    """``doc_id, text_hash, component_id, component_hash`` per document: groups linked by similarity of word shingles.

    Two documents link when the Jaccard similarity of their sets of shingle hashes is ``similarity`` or
    more; every link is checked on the sets. Candidates are pairs whose 128-bit SimHash fingerprints are
    within ``wide_radius(similarity)`` and agree on one of ``keys`` fixed random choices of ``key_bits``
    bits. The fingerprints of small sets scatter too much for that, so pairs with a set of at most ``short``
    hashes also meet wherever their rarest hashes do (``rare_keys``), at any distance: no such link is lost.
    Pairs already connected are not looked at again. Equal sets are one node. Buckets above
    ``bucket`` nodes are compared block against block in many tasks, and the result does not depend on it.
    ``component_id`` is the smallest id of the group, ``text_hash`` Spark's xxhash64 of a text and
    ``component_hash`` the smallest one of that id in the group, as rows may share an id and not the text.
    Null ids are left out; texts without words are alike; repeated rows count once.
    """
    radius = wide_radius(similarity)
    least = int(np.ceil(similarity / (1 - similarity) - 1e-9)) if similarity < 1 else 1 << 40  # smaller sets are alike only if equal
    widest = int(short / similarity + 1e-9)  # a set of ``short`` hashes is not like larger ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release_caches()
        for part in slices(batches):
            with no_cycle_search():
                sets = [np.unique(shingle_hashes(t, words)) for t in bytes_of(part)]
                fps = np.array([wide_fingerprint(h) for h in sets], dtype="<u8").reshape(-1, 2).view("<i8")
                node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("text_hash"), pa.array(node), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array([len(h) for h in sets], pa.int64()),
                                              pa.array([h.view("<i8") if len(h) <= widest else None for h in sets], pa.list_(pa.int64()))],
                                             ["doc_id", "text_hash", "node", "f0", "f1", "n", "h"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release_caches()
        for part in slices(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in bytes_of(part)]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], dtype="<u8").view("<i8")
            hist = [np.bincount((mixed(h) >> np.uint64(57)).astype(np.int64), minlength=BINS).astype("<u4").tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([h.view("<i8") for h in sets], pa.list_(pa.int64())), pa.array(hist, pa.binary())], ["node", "h", "hist"])

    rng = np.random.default_rng(SEED)
    base = np.array([rng.permutation(128)[:key_bits] for _ in range(keys)])
    masks = np.array([[sum(1 << int(b) % 64 for b in places if b // 64 == w) for w in (0, 1)] for places in base], dtype=np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fp = np.column_stack([batch.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")])
                again = [np.repeat(batch.column(c).to_numpy(), keys) for c in ("node", "f0", "f1", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.tile(np.arange(keys), len(fp)), _pick(fp, base).ravel(), *again)], ["way", "key", "node", "f0", "f1", "n"])

    given = id_text(docs, id_col, text_col).where("_id is not null")
    marked = settle(given.select("_id", "_text", F.xxhash64("_text").alias("text_hash"))
                    .mapInArrow(run, "doc_id long, text_hash long, node long, f0 long, f1 long, n long, h array<long>"))
    distinct = settle(marked.groupBy("node", "f0", "f1", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("h").alias("h")))
    columns = ["way", "key", "a", "b", "node", "f0", "f1", "n", "own"]

    def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """The rows to compare at first, those of buckets that fit, and all blocks of the others."""
        over = settle(rows.groupBy("way", "key").count().where(F.col("count") > bucket).withColumn("blocks", F.ceil(F.col("count") / bucket)))
        single = {c: F.lit(0).cast("long") for c in ("own", "a", "b")}
        if over.isEmpty():
            return (rows.withColumns(single).select(columns),) * 2 + (None,)
        # Names are hashes, so the least of them are a fair draw: these meet every block at first.
        fit = rows.join(over, ["way", "key"], "left_anti").withColumns(single).select(columns)
        large = rows.join(over, ["way", "key"]).withColumn("own", F.pmod("node", "blocks"))
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        pivot = F.col("node") < -float(1 << 63) + float(1 << 64) * PIVOTS / F.col("count")
        at_first = large.withColumn("a", F.explode(F.when(pivot, every).otherwise(F.array("own")))).withColumn("b", F.col("a"))
        blocks = large.withColumn("_x", F.explode(every)).withColumn("a", F.least("own", "_x")).withColumn("b", F.greatest("own", "_x"))
        return fit.union(at_first.select(columns)), fit, blocks.select(columns)

    able = distinct.where(F.col("n") >= least)
    by_bits = able.select("node", "f0", "f1", "n").mapInArrow(spread, "way long, key long, node long, f0 long, f1 long, n long")
    searches = [(by_bits, radius, masks)]
    if short >= least:
        searches.append((settle(rare_keys(able.where(F.col("n") <= widest), similarity)), 128, masks[:0]))
    searches = [(*dealt(rows), reach, met) for rows, reach, met in searches]
    found = [settle(bucket_pairs(first, reach, similarity, met, False)) for first, _, _, reach, met in searches]

    def checked(pairs: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The pairs that are alike, and the sets that are known by then."""
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        nodes = settle(nodes if known is None else nodes.join(known.select("node"), "node", "left_anti"))
        ids = settle(distinct.join(nodes, "node", "left_semi").select(F.col("first.doc_id").alias("_id")).distinct())
        sets = (given.join(ids, "_id", "left_semi").mapInArrow(spell, "node long, h array<long>, hist binary")
                .join(nodes, "node", "left_semi").groupBy("node").agg(F.first("h").alias("h"), F.first("hist").alias("hist")))
        sets = settle(sets)
        sets = sets if known is None else known.union(sets)
        return settle(alike(pairs, sets, similarity)), sets

    def pairs_of(parts: list[DataFrame]) -> DataFrame:
        return settle(reduce(DataFrame.union, [x.where("u is not null").select("u", "v") for x in parts]).distinct())

    links, sets = checked(pairs_of(found), None)
    group = settle(components(links))
    comp = group.withColumnRenamed("root", "comp")
    again = []
    for got, (_, fit, blocks, reach, met) in zip(found, searches):
        open_ = settle(got.where("u is null").select("way", "key", "a", "b").distinct())
        if blocks is None and open_.isEmpty():
            continue
        left = fit.join(open_, ["way", "key", "a", "b"], "left_semi")
        left = left if blocks is None else left.union(blocks)
        left = settle(left.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        mixed_up = left.groupBy("way", "key", "a", "b").agg(F.min("comp").alias("_l"), F.max("comp").alias("_m")).where("_l != _m")
        left = left.join(mixed_up, ["way", "key", "a", "b"], "left_semi").join(sets.select("node", "hist"), "node", "left")
        again.append(bucket_pairs(left, reach, similarity, met, True))
    if again:
        pairs = pairs_of(again)
        if not pairs.isEmpty():
            more, _ = checked(pairs, sets)
            group = settle(components(links.union(more)))
    named = distinct.join(group, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("_first"))
    return marked.join(named.join(ids, "root").select("node", "_first"), "node").select(
        "doc_id", "text_hash", F.col("_first.doc_id").alias("component_id"), F.col("_first.text_hash").alias("component_hash"))
