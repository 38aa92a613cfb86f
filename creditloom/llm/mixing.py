"""Mixing sources to target weights by entropy balancing.

Documents get rates that are closest in relative entropy, counted per document, to taking every
document once, while each source's words meet its target and no rate passes ``most``. The solution
is an exponential tilt by length, rate = min(most, exp(lambda * words)) with one lambda a source.
The dual is convex and separable by source; its gradient and curvature are moments of the tilted
sizes, summed on Spark in every iteration of Newton's method over the exact histogram of sizes per
source, for all sources at once. Rates become whole copies by error diffusion within bounded chunks
of a source, largest documents first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import WORD
from creditloom.operators.scans import global_row_number
from creditloom.operators.sizing import settle

CHUNK = 4096
SALTS = 64


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``_null, _source, source_size, target`` per source of ``sized(_null, _source, size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes. A target stops at ``most`` times its source's size; the excess goes to the others by
    weight until none is above.
    """
    sums = settle(sized.groupBy("_null", "_source").agg(F.sum("size").alias("source_size")))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = settle(global_row_number(sums, ["_null", "_source"], "_nth")
                   .select("_null", "_source", "source_size", turn[((F.col("_nth") - 1) % len(weights)).cast("int")].alias("_w"),
                           (most * F.col("source_size")).alias("_cap")))
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, F.lit(False)
    while True:
        full, rest = table.agg(F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)), F.sum(F.when(~capped, F.col("_w")).otherwise(0.0))).first()
        if not rest:
            break
        level = max(level, (total - full) / rest)
        above = F.col("_w") * level >= F.col("_cap")
        if table.where(above).agg(F.sum("_cap")).first()[0] in (None, full):
            break
        capped = above
    return table.select("_null", "_source", "source_size", F.least(F.col("_w") * level, F.col("_cap")).alias("target"))


def tilt(sized: DataFrame, targets: DataFrame, most: float = 2.0, tolerance: float = 1e-9, steps: int = 200) -> DataFrame:
    """Add ``_lambda`` and ``_unit`` per source: a document's rate is min(most, exp(_lambda * size / _unit)).

    Newton's steps go on the logarithm of the dual's gradient (the tilted words over the target),
    kept inside the bracket of what was seen so far; where the bound leaves no curvature, the bracket
    is halved. ``_unit`` is a source's mean size. ``_lambda`` is null where no tilt is wanted: sources
    without words, of target zero, or whose target is all they may give. It is rounded to ten digits,
    so that the order of sums plays no part in it.
    """
    key, top = ["_null", "_source"], math.log(most)
    hist = settle(sized.where("size > 0").groupBy(*key, "size").agg(F.count("*").alias("_n")))
    facts = hist.groupBy(*key).agg((F.sum(F.col("size") * F.col("_n")) / F.sum("_n")).alias("_unit"), F.min("size").alias("_least"))
    wanted = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12))
    none, zero, more = F.lit(None).cast("double"), F.lit(0.0), F.col("target") > F.col("source_size")
    now = settle(targets.join(facts, key, "left").withColumns({
        "_lambda": F.when(wanted, zero), "_lo": F.when(more, zero).otherwise(none),
        "_hi": F.when(more, top * F.col("_unit") / F.col("_least")).otherwise(zero), "_gap": none}).drop("_least"))
    z = F.col("_lambda") * F.col("size") / F.col("_unit")
    words = F.col("size") * F.col("_n") * F.exp(F.least(z, F.lit(top)))
    state = ["_lambda", "_lo", "_hi", "_gap", "_unit"]
    for _ in range(steps):
        moments = (hist.join(now.where("_lambda is not null").select(*key, "_lambda", "_unit"), key).groupBy(*key)
                   .agg(F.sum(words).alias("_m"), F.sum(F.when(z < top, words * F.col("size") / F.col("_unit")).otherwise(0.0)).alias("_c")))
        gap = F.log(F.col("_m") / F.col("target"))
        step = F.col("_lambda") - F.try_divide(gap * F.col("_m"), F.col("_c"))
        seen = (now.join(moments, key, "left").withColumn("_gap", gap)
                .withColumn("_lo", F.when(F.col("_gap") < 0, F.col("_lambda")).otherwise(F.col("_lo")))
                .withColumn("_hi", F.when(F.col("_gap") > 0, F.col("_lambda")).otherwise(F.col("_hi"))))
        inside = step.isNotNull() & F.coalesce(step > F.col("_lo"), F.lit(True)) & F.coalesce(step < F.col("_hi"), F.lit(True))
        moved = F.when(F.abs("_gap") <= tolerance, F.col("_lambda")).when(inside, step).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        now = settle(seen.withColumn("_lambda", F.when(F.col("_lambda").isNotNull(), F.coalesce(moved, F.col("_lambda")))).select(*targets.columns, *state))
        worst = now.agg(F.max(F.abs("_gap"))).first()[0]
        if worst is None or worst <= tolerance:
            break
    digits = F.pow(F.lit(10.0), F.floor(F.log10(F.abs("_lambda"))) - 9)
    return now.select(*targets.columns, "_unit", F.when(F.col("_lambda") == 0, zero).otherwise(F.round(F.col("_lambda") / digits) * digits).alias("_lambda"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, rate, copies, taken`` per document, and the columns ``keep``
    (of type long), by which a caller may tell rows apart that have no id or share one.

    ``size`` counts words (null or empty text: 0), ``taken`` is copies times size, copies never
    exceed ``most`` rounded up. A null source is a source, ordered last. A document without words is
    taken once, as its tilt is 1. Ties in size are broken by a hash of the id, so reruns and other
    partitionings agree; repeated rows count as documents of their own. Empty tables stay empty.
    """
    sized = settle(docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(source_col).isNull().cast("int").alias("_null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep))
    sources = settle(tilt(sized, source_targets(sized, weights, share, most), most))
    tie = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))
    ranked = settle(global_row_number(sized.withColumn("_tie", tie), ["_null", "_source", F.desc("size"), "_tie", "_id", *keep], "_nth"))
    first = ranked.groupBy("_null", "_source").agg(F.min("_nth").alias("_first"))
    # A source may hold a third of all documents: the few facts of each source are dealt to SALTS
    # places, so that its documents are too.
    facts = sources.join(first, ["_null", "_source"]).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rate = (F.when(F.col("size") == 0, 1.0).when(F.col("_lambda").isNotNull(), F.least(F.exp(F.col("_lambda") * F.col("size") / F.col("_unit")), F.lit(float(most))))
            .when(F.col("target") > 0, float(most)).otherwise(0.0))
    placed = (ranked.withColumn("_salt", F.pmod("_nth", F.lit(SALTS))).join(facts, ["_null", "_source", "_salt"]).withColumn("rate", rate)
              .withColumn("_chunk", F.floor((F.col("_nth") - F.col("_first")) / CHUNK)))

    def diffuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies in turn, the words still owed carried on; each chunk starts anew."""
        chunk, owed = None, 0.0
        for batch in batches:
            copies = []
            for null, source, nth, size, rate in zip(*(batch.column(c).to_pylist() for c in ("_null", "_source", "_chunk", "size", "rate"))):
                if (null, source, nth) != chunk:
                    chunk, owed = (null, source, nth), 0.0
                owed += rate * size
                n = math.floor(owed / size + 0.5) if size else 0
                n = min(max(n, math.floor(rate)), math.ceil(rate))
                owed -= n * size
                copies.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_id", "size", "source_size", "target", "rate")]
                + [pa.array(copies, pa.int64()), pa.array([n * s for n, s in zip(copies, batch.column("size").to_pylist())], pa.int64())]
                + [batch.column(c) for c in keep],
                ["doc_id", "size", "source_size", "target", "rate", "copies", "taken", *keep])

    return (placed.select("_id", "_null", "_source", "_chunk", "_nth", "size", "source_size", "target", "rate", *keep)
            .repartition("_null", "_source", "_chunk").sortWithinPartitions("_null", "_source", "_chunk", "_nth")
            .mapInArrow(diffuse, "doc_id long, size long, source_size long, target double, rate double, copies long, taken long" + "".join(f", {c} long" for c in keep)))
