"""Application records to one wide feature row each.

Everything is expressions on the record's own row. The only shuffles are those of generated
labels, which count distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions import labels as L
from creditloom.functions.numeric import (
    HIDDEN, MISSING, as_flag, bare_numeric, bare_text, below_threshold, clean_numeric, number_or, row_median, to_number,
)
from creditloom.functions.text import let
from creditloom.operators.autolabel import auto_labels, frozen_labels, label_table
from creditloom.operators.quality import require_columns
from creditloom.operators.sizing import settle
from creditloom.plans.column_schema import AUTO, ColumnSpec

# Offer name, column prefix, and the texts used when the offer is absent.
OFFERS = [
    ("Automatic Financing", "AutomaticFinancing", "NA", "NA"),
    ("0% Unsecured Funding", "0UnsecuredFunding", "NA", "-1"),
    ("Debt Resolution", "DebtResolution", "", ""),
]
NUMERIC_SUFFIXES = ["_Score", "_Amount", "_DebtToIncome", "_PayD", "_Collections"]
TEXT_KEYS = ["Name", "Details", "Contingencies", "Status"]
KEPT_TEXT = ("_Name", "_Details", "_Contingencies", "_Status", "final_contract_status",
             "user_initials", "record_id")
DTI_COLUMNS = ["AutomaticFinancing_DebtToIncome", "0UnsecuredFunding_DebtToIncome",
               "DebtResolution_DebtToIncome", "DebtToIncome"]
AMOUNT_COLUMNS = ["AutomaticFinancing_Amount", "0UnsecuredFunding_Amount", "DebtResolution_Amount",
                  "final_contract_amount"]


def strict_offers(offers: Column) -> Column:
    """Loosely read offers (a variant) as typed structs; elements without a name are skipped."""
    items = F.try_variant_get(offers, "$", "array<variant>")
    named = F.filter(items, lambda o: F.try_variant_get(o, "$.Name", "string").isNotNull())
    keys = ["Name", "Status", "Amount", "DebtToIncome", "Details", "Contingencies"]
    return F.transform(named, lambda o: F.struct(
        *[F.try_variant_get(o, f"$.{k}", "string").alias(k) for k in keys],
        F.try_variant_get(o, "$.Score", "variant").alias("Score"),
    ))


def last_offers(offers: Column) -> Column:
    """The last named offer of every type, in the order of ``OFFERS``; null where there is none.

    Elements are the offer with its clean name. Only these are cleaned further.
    """
    named = F.transform(F.filter(offers, lambda o: o["Name"].isNotNull()),
                        lambda o: F.struct(L.sanitize_value(o["Name"]).alias("name"), o.alias("given")))
    last = lambda n, prefix: F.try_element_at(F.filter(n, lambda o: o["name"] == prefix), F.lit(-1))
    return let(named, lambda n: F.array(*[last(n, prefix) for _, prefix, _, _ in OFFERS]))


def clean_offers(offers: Column) -> Column:
    """Offers with clean names (``last_offers``), every value parsed, defaulted and flagged, in the given order.

    They are few per record, so they are cleaned as array elements, in steps: what a step uses more
    than once is a field made by the step before, since nothing else is shared inside lambdas.
    """
    low, debt = OFFERS[1][1], OFFERS[2][1]

    def read(x: Column) -> Column:
        o = x["given"]
        note = F.when(x["name"] == low, F.coalesce(o["Contingencies"], F.lit("")))
        return F.struct(
            x["name"].alias("name"), F.try_variant_get(o["Score"], "$", "string").alias("score"),
            F.coalesce(F.schema_of_variant(o["Score"]).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False)).alias("is_number"),
            F.coalesce(F.nullif(o["Status"], F.lit("")), F.lit("NA")).alias("status"),
            bare_text(o["Amount"]).alias("amount"), bare_text(o["DebtToIncome"]).alias("dti"),
            F.regexp_extract(note, r"PayD-\$([\d,]+)", 1).alias("payd"),
            F.regexp_extract(note, r"Collections-\$([\d,]+)", 1).alias("coll"),
            o["Details"].alias("details"), o["Contingencies"].alias("contingencies"),
        )

    def parse(o: Column) -> Column:
        blank = o["name"].isin(low, debt) & F.trim(o["status"]).isin("", "NA")
        return F.struct(
            o["name"].alias("name"), o["score"].alias("score"), o["is_number"].alias("is_number"),
            bare_text(o["score"]).alias("bare"), F.when(blank, "Declined").otherwise(o["status"]).alias("status"),
            F.coalesce(bare_numeric(o["amount"]), F.lit(0.0)).alias("amount"), bare_numeric(o["dti"]).alias("dti"),
            F.when(o["payd"] == "", 0.0).otherwise(clean_numeric(o["payd"])).alias("payd"),
            F.when(o["coll"] == "", 0.01).otherwise(clean_numeric(o["coll"])).alias("coll"),
            o["details"].alias("details"), o["contingencies"].alias("contingencies"),
        )

    def score(o: Column) -> Column:
        number, flag = below_threshold(o["score"], o["is_number"], value=bare_numeric(o["bare"]))
        return F.struct(o.alias("o"), number.alias("score"), flag.alias("low"), ((o["name"] == debt) & (o["status"] == "Declined")).alias("declined"))

    def finish(s: Column) -> Column:
        o, declined = s["o"], s["declined"]
        return F.struct(
            o["name"].alias("name"),
            F.coalesce(s["score"], F.when(declined, HIDDEN), F.lit(MISSING)).alias("score"),
            s["low"].alias("low"), (declined & s["score"].isNull()).cast("int").alias("hidden"),
            o["status"].alias("status"), o["amount"].alias("amount"),
            F.coalesce(o["dti"], F.when(declined, HIDDEN), F.lit(MISSING)).alias("dti"),
            o["payd"].alias("payd"), o["coll"].alias("coll"),
            o["details"].alias("details"), o["contingencies"].alias("contingencies"),
        )

    def each(items: Column, step: Callable[[Column], Column]) -> Column:
        return F.transform(items, lambda o: F.when(o.isNotNull(), step(o)))

    return each(each(each(each(offers, read), parse), score), finish)


def offer_columns(offer: Column, raw_name: str, prefix: str, details: str, contingencies: str) -> dict[str, Column]:
    """The flat columns of one offer type from its cleaned struct, or its absence values."""
    absent = offer.isNull()

    def pick(missing, present: Column) -> Column:
        return F.when(absent, F.lit(missing)).otherwise(present)

    out = {
        f"{prefix}_missing_": F.when(absent, 1).otherwise(0),
        f"{prefix}_Name": pick("NA", F.lit(raw_name)),
        f"{prefix}_Score": pick(MISSING, offer["score"]),
        f"{prefix}_below_600_": pick(-1, offer["low"]),
        f"{prefix}_Status": pick("NA", offer["status"]),
        f"{prefix}_Amount": pick(MISSING, offer["amount"]),
        f"{prefix}_DebtToIncome": pick(MISSING, offer["dti"]),
        f"{prefix}_Details": pick(details, offer["details"]),
        f"{prefix}_Contingencies": pick(contingencies, offer["contingencies"]),
    }
    if prefix == OFFERS[1][1]:
        out[f"{prefix}_PayD"] = pick(MISSING, offer["payd"])
        out[f"{prefix}_Collections"] = pick(MISSING, offer["coll"])
    if prefix == OFFERS[2][1]:
        out[f"{prefix}_score_missing_"] = pick(-1, offer["hidden"])
    return out


def latest_contract(contracts: Column) -> Column:
    """Most recent contract by created_at as a struct; ties keep the first element."""
    typed = F.transform(contracts, lambda c, i: F.struct(
        F.try_to_timestamp(c["created_at"]).alias("at"), (-i).alias("pos"),
        c["status"].alias("status"), c["tier"].alias("tier"), c["amount"].alias("amount"),
    ))
    return F.array_max(typed)


def flatten_records(records: DataFrame) -> DataFrame:
    """One flat row per record: ids, latest contract and the columns of the three offers."""
    offers = F.col("prefi_data.Offers")
    if isinstance(records.schema["prefi_data"].dataType["Offers"].dataType, T.VariantType):
        offers = strict_offers(offers)
    work = records.select(
        "record_id", "user_initials", clean_numeric(F.col("prefi_data.DataEnhance.DebtToIncome")).alias("DebtToIncome"),
        latest_contract(F.col("contracts")).alias("_c"), clean_offers(last_offers(offers)).alias("_o"),
    )
    picked = work.select("*", *[F.get("_o", i).alias(f"_o{i}") for i in range(len(OFFERS))])
    has = F.col("_c").isNotNull()
    flat = {
        "final_contract_status": F.when(has, F.coalesce("_c.status", F.lit("NA"))),
        "final_contract_tier": F.when(has, number_or(F.col("_c.tier"), MISSING)),
        "final_contract_amount": F.when(has, number_or(F.col("_c.amount"), MISSING)),
    }
    for i, (raw, prefix, details, contingencies) in enumerate(OFFERS):
        flat |= offer_columns(F.col(f"_o{i}"), raw, prefix, details, contingencies)
    return picked.select("record_id", "user_initials", "DebtToIncome", *[c.alias(n) for n, c in flat.items()])


def add_sentinels(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Insert absent columns: -1 for numeric-style names, 'NA' for the others."""
    fill = {n: F.lit(MISSING) if any(s in n for s in NUMERIC_SUFFIXES) else F.lit("NA")
            for n in names if n not in df.columns}
    return df.withColumns(fill) if fill else df


def align(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are 0, extra ones are dropped."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(0).alias(n) for n in dict.fromkeys(names)])


def _derive(df: DataFrame, spec: ColumnSpec, by_name: dict[str, ColumnSpec]) -> DataFrame:
    source = spec.labels_from or spec.mapped_from
    if source not in df.columns:
        raise ValueError(f"{spec.name} is derived from {source}, which is absent")
    src, dtype = by_name.get(source), df.schema[source].dataType
    if spec.labels_from:
        if src is not None and src.frozen is not None:
            return frozen_labels(df, source, spec.name, src.frozen, src.other_label)
        if src is not None and src.labels == AUTO and src.methods:
            return auto_labels(df, source, spec.name, src.methods)
        table = src.labels if src is not None and isinstance(src.labels, dict) else {}
        other = src.other_label if src is not None else -1
        return df.withColumn(spec.name, L.map_label(F.col(source), table, dtype, other))
    return df.withColumn(spec.name, L.map_value(F.col(source), (src.mapping if src else None) or {}, dtype))


def freeze_labels(flat: DataFrame, specs: Sequence[ColumnSpec]) -> list[ColumnSpec]:
    """The schema with generated labels replaced by the tables they give on this data.

    Scoring then labels new records as in training, without counting anything, so it also works
    on a stream (a static join). Nulls keep the label they had; values outside the table get the
    label of the group "other", or -1 where training had no such group.
    """
    out = []
    for s in specs:
        if s.labels == AUTO and s.methods:
            table = settle(label_table(flat, s.name, s.methods))
            rest = table.where("_group = 'other'").select("_label").first()
            s = replace(s, frozen=table, other_label=-1 if rest is None else int(rest["_label"]))
        out.append(s)
    return out


def encode(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """Labels, mappings and one-hot columns, in schema order."""
    by_name = {s.name: s for s in specs}
    for s in specs:
        if s.labels_from or s.mapped_from:
            df = _derive(df, s, by_name)
        if s.ohe and s.name in df.columns:
            df = df.withColumns({out: L.one_hot(F.col(s.name), raw) for raw, out in s.ohe.items()})
        elif s.ohe_from and s.ohe_key and s.name in df.columns and s.ohe_from in df.columns:
            df = df.withColumn(s.name, L.one_hot(F.col(s.ohe_from), s.ohe_key))
    return df


def clean_text_columns(df: DataFrame) -> DataFrame:
    """Name, details, contingency and status columns: nulls and numeric sentinels become 'NA'."""
    out = {}
    for f in df.schema.fields:
        if any(f.name == k or f.name.endswith(f"_{k}") for k in TEXT_KEYS):
            c = F.col(f.name)
            if isinstance(f.dataType, T.NumericType):
                out[f.name] = F.when(c.isNull() | c.isin(-1, -999, 0), "NA").otherwise(c.cast("string"))
            else:
                out[f.name] = F.coalesce(c, F.lit("NA"))
    return df.withColumns(out) if out else df


def merge_medians(df: DataFrame, specs: Sequence[ColumnSpec], hidden_is_missing: bool = False) -> DataFrame:
    """Debt-to-income columns become one median; paired score columns are merged when both say so.

    -1 and 0 are ignored in the debt-to-income median; ``hidden_is_missing`` ignores -999 too.
    """
    dti = [c for c in DTI_COLUMNS if c in df.columns]
    if dti:
        ignore = (-1.0, 0.0, HIDDEN) if hidden_is_missing else (-1.0, 0.0)
        df = df.withColumn("Merged_DebtToIncome", row_median([F.col(c) for c in dti], ignore))
    df = df.drop(*[c for c in dti if c != "DebtToIncome"])
    by_name = {s.name: s for s in specs}
    first, second = "AutomaticFinancing_Score", "0UnsecuredFunding_Score"
    mutual = (first in by_name and second in by_name
              and by_name[first].median_with == second and by_name[second].median_with == first)
    if mutual and first in df.columns and second in df.columns:
        both = [to_number(F.col(c), df.schema[c].dataType) for c in (first, second)]
        return df.withColumn(first, row_median(both)).drop(second)
    return df.withColumns({
        c: number_or(F.col(c), MISSING, df.schema[c].dataType) for c in (first, second) if c in df.columns
    })


def drop_text(df: DataFrame) -> DataFrame:
    """Drop text columns that are not ids or raw offer texts."""
    return df.drop(*[f.name for f in df.schema.fields
                     if isinstance(f.dataType, T.StringType) and not f.name.endswith(KEPT_TEXT)])


def feature_table(flat: DataFrame, specs: Sequence[ColumnSpec], check: bool = False) -> DataFrame:
    """Flat rows to the model-ready table described by the column schema."""
    flat = add_sentinels(flat, [s.name for s in specs if not s.derived])
    out = align(encode(flat, specs), [s.name for s in specs])
    out = clean_text_columns(out)
    hot = {c for s in specs for c in (s.ohe or {}).values()} | {s.name for s in specs if s.ohe_from and s.ohe_key}
    out = out.withColumns({c: as_flag(F.col(c), out.schema[c].dataType) for c in out.columns if c in hot})
    out = merge_medians(out, specs)
    zero = [c for c in [*AMOUNT_COLUMNS, *DTI_COLUMNS] if c in out.columns]
    out = drop_text(out.withColumns({c: number_or(F.col(c), 0.0, out.schema[c].dataType) for c in zero}))
    if check:
        required = [f.name for f in out.schema.fields if not isinstance(f.dataType, T.StringType)]
        require_columns(out, required)
    return out
