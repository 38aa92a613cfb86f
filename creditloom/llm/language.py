"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is cut
greedily into the longest phrases that occur in the sample; the fewer phrases a language needs,
the closer the text is to it. Letters are numbered by frequency over all samples: the most frequent are
one symbol each, all others are spelled in digits, so no alphabet is too large. Phrase counts are normalised by the logarithm of the sample's
length (Ziv and Merhav's estimate of cross entropy). Texts are parsed in blocks of 512 symbols,
many blocks side by side, each block from the automaton's root; a block's end closes a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.common import release_caches, slices, texts_of

ROWS, ROW_CHARS, SAMPLE = 128, 1024, 32_768
CLASSES = 64
OTHER, SINGLE, DIGITS = 1, 30, 32
CELLS = 48_000_000
BLOCK = 512


def held_out(id_col: str = "doc_id"):
    """Documents that no model may learn from. A document without an id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letter_table(texts: list[str]) -> np.ndarray:
    """How every code point is spelled in symbols, as one number: 0 for what is no letter, ``OTHER`` for
    letters that no sample has, 2.. for the samples' ``SINGLE`` most frequent letters, and from ``CLASSES``
    on, ``CLASSES`` plus the rank among the rest. Upper and lower case share a number."""
    code_points = range(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in code_points), dtype=bool, count=0x110000)
    counts = np.bincount(np.frombuffer("".join(texts).lower().encode("utf-32-le"), dtype="<u4"), minlength=0x110000)
    counts[~letter[: len(counts)]] = 0
    seen = [int(c) for c in np.lexsort((np.arange(len(counts)), -counts))[: int((counts > 0).sum())]]
    of = {c: 2 + i if i < SINGLE else CLASSES + i - SINGLE for i, c in enumerate(seen)}
    table = letter.astype(np.int32) * OTHER
    for c in np.nonzero(letter)[0].tolist():
        low = chr(c).lower()
        k = of.get(c) or of.get(ord(low[0]))
        if k:
            table[c] = k
    return table


def spelled(numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ``letter_table`` as symbols, and how many each takes: one, or ``width`` digits for
    letters beyond the most frequent ones. Digits are symbols that stand for no letter of their own."""
    rare = numbers >= CLASSES
    if not rare.any():
        return numbers.astype(np.uint8), np.ones(len(numbers), dtype=np.int64)
    takes = np.where(rare, width, 1)
    ends = np.cumsum(takes)
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    out[ends[~rare] - 1] = numbers[~rare]
    at, rest = ends[rare] - 1, numbers[rare] - CLASSES
    for k in range(width):
        out[at - k] = 2 + SINGLE + rest % DIGITS
        rest = rest // DIGITS
    return out, takes


def digits_of(table: np.ndarray) -> int:
    """Digits that tell all letters beyond the most frequent ones apart."""
    most, width = int(table.max()) - CLASSES, 1
    while DIGITS ** width <= most:
        width += 1
    return width


def symbols(texts: list[str], table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spelled letters of the texts behind each other, with one 0 for each run of other characters;
    the symbols and the letters of each text."""
    if not texts:
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    numbers = table[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype="<u4")]
    keep = numbers > 0
    starts = np.concatenate(([0], ends[:-1]))
    letters = np.add.reduceat(keep, starts, dtype=np.int64)
    keep[1:] |= numbers[:-1] > 0
    seq, takes = spelled(numbers[keep], width)
    size = np.zeros(len(numbers), dtype=np.int64)
    size[keep] = takes
    return seq, np.add.reduceat(size, starts), letters


def automaton(text: np.ndarray) -> np.ndarray:
    """The suffix automaton of ``text`` as a parsing table.

    ``table[state + symbol]`` is four times the next state (a multiple of CLASSES) plus the phrases that
    end here: the one before, if it could not go on and a new one began with the symbol, and the
    symbol alone if the sample lacks it.
    """
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    restart = np.zeros(CLASSES, dtype=np.int32)
    for c, s in steps[0].items():
        restart[c] = 4 * CLASSES * s
    table = np.tile(np.where(restart > 0, restart | 1, 2).astype(np.int32), (len(steps), 1))
    for s, out in enumerate(steps):
        for c, t in out.items():
            table[s, c] = 4 * CLASSES * t
    table[0] = np.where(restart > 0, restart, 1)
    return table.ravel()


def phrases(blocks: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases of each block; ``blocks`` has a column per block, longest first."""
    count = np.zeros(blocks.shape[1], dtype=np.int32)
    state = np.zeros(blocks.shape[1], dtype=np.int32)
    active = np.searchsorted(-sizes, -np.arange(blocks.shape[0]), side="left")
    for t in range(blocks.shape[0]):
        n = active[t]
        if n == 0:
            break
        got = table.take(state[:n] + blocks[t, :n])
        count[:n] += got & 3
        np.right_shift(got, 2, out=state[:n])
    return count + (state > 0)


def sample_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = ROWS,
                 row_chars: int = ROW_CHARS) -> dict[str, list[str]]:
    """At most ``rows`` labelled texts per language, the smallest hashes first, each up to
    ``row_chars`` code points. Only documents that are not held out are read."""
    known = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = W.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ids = (known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
           .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows))
    texts = known.select(F.col(id_col).alias("_id"), F.substring(text_col, 1, row_chars).alias("_part"))
    found: dict[str, list[str]] = {}
    picked = texts.join(F.broadcast(ids), "_id").select("_lang", "_rank", "_part").collect()
    for r in sorted(picked, key=lambda r: (r["_lang"], r["_rank"], r["_part"])):
        found.setdefault(r["_lang"], []).append(r["_part"])
    return found


def fit(samples: dict[str, list[str]], sample: int = SAMPLE) -> dict:
    """Spelling of letters and an automaton per language. The sample's length shrinks with the number
    of languages, so that all tables together stay below CELLS entries."""
    most = min(sample, CELLS // (2 * CLASSES * max(1, len(samples))))
    letters = letter_table([t for texts in samples.values() for t in texts])
    width = digits_of(letters)
    tables = {}
    for lang in sorted(samples):
        text = symbols(samples[lang], letters, width)[0][:most]
        if (text > 0).any():
            tables[lang] = (automaton(text), float(np.log2(max(2, len(text)))))
    return {"letters": letters, "width": width, "tables": tables}


def rates(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Normalised phrases per symbol, a row per text and a column per language; letters per text."""
    seq, sizes, letters = symbols(texts, model["letters"], model["width"])
    starts = np.cumsum(sizes) - sizes
    blocks_of = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks_of)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of)
    length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
    order = np.argsort(-length, kind="stable")
    begin, length = (starts[owner] + nth * BLOCK)[order], length[order]
    padded = np.concatenate((seq, np.zeros(BLOCK, dtype=np.uint8)))
    longest = int(length[0]) if len(length) else 0
    blocks = padded[begin[None, :] + np.arange(longest)[:, None]]
    out = np.zeros((len(texts), len(model["tables"])))
    for k, (table, bits) in enumerate(model["tables"].values()):
        got = phrases(blocks, length, table) if longest else np.zeros(0)
        out[:, k] = np.bincount(owner[order], weights=got, minlength=len(texts)) * bits / np.maximum(1, sizes)
    return out, letters


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             rows: int = ROWS, row_chars: int = ROW_CHARS, sample: int = SAMPLE, keep_row: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rate`` per document, and with ``keep_row`` the whole
    document as the struct ``row``, so that its columns need no join.

    ``rate`` is the best language's normalised phrases per symbol (an entropy in bits), ``score``
    the runner-up's rate as a share of both (1.0 if only one language was learned). Null texts,
    texts without a letter and everything when nothing could be learned: ``und``, score 0, rate
    null. Ties go to the language first in code-point order. Repeated rows stay; other columns are
    ignored, and language, source and id take no part in a prediction.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(sample_texts(docs, id_col, text_col, lang_col, rows, row_chars), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        known = model.value
        langs = list(known["tables"])
        if keep_row:  # the text is in the row already and need not travel twice
            batches = (b.append_column("_text", pc.struct_field(b.column("row"), text_col).cast(pa.string())) for b in batches)
        for part in slices(batches):
            rate, letters = rates(texts_of(part), known)
            if langs:
                best = rate.argmin(axis=1)
                first = rate.min(axis=1)
                rest = np.partition(rate, 1, axis=1)[:, 1] if len(langs) > 1 else None
                score = np.ones(len(first)) if rest is None else rest / np.maximum(first + rest, 1e-12)
            none = letters == 0 if langs else np.ones(len(letters), dtype=bool)
            yield pa.RecordBatch.from_arrays([
                part.column("_id"), part.column("_held"),
                pa.array(["und" if x else langs[best[i]] for i, x in enumerate(none)], pa.string()),
                pa.array([0.0 if x else float(score[i]) for i, x in enumerate(none)], pa.float64()),
                pa.array([None if x else float(first[i]) for i, x in enumerate(none)], pa.float64()),
                *([part.column("row")] if keep_row else []),
            ], names)

    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows_in = docs.select(F.col(id_col).cast("long").alias("_id"), held_out(id_col).alias("_held"),
                          whole if keep_row else F.col(text_col).cast("string").alias("_text"))
    types = T.StructType.fromDDL("doc_id long, held_out boolean, lang_pred string, score double, rate double")
    names = types.names + ["row"] * keep_row
    return rows_in.mapInArrow(run, types.add(rows_in.schema["row"]) if keep_row else types)
