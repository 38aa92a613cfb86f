"""Credit-report JSON, phrase-check logs and expectation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.scans import chunk_of, prefix_scan

_PAIR = "struct<count: bigint, amount: bigint>"
_CARD = ("struct<color: string, hex: string, balance: bigint, limit: bigint, Percent: bigint, Payment: bigint, "
         "utilization_percent: bigint>")
# One report with every spelling of its fields that occurs.
REPORT = f"""
filename string, source string, pdf_file string, credit_score variant, credit_score_color string, age int,
address variant, collections_open int, collections_closed int, collections_open_count int,
collections_closed_count int, collections struct<open: int, closed: int>, public_records int,
public_records_details struct<detail: string, date: string, color: string, hex: string>,
revolving_open_count bigint, revolving_open_total bigint, revolving_accounts_open {_PAIR},
installment_open_count bigint, installment_open_total bigint, installment_accounts_open {_PAIR},
real_estate_open_count bigint, real_estate_open_total bigint, real_estate_open {_PAIR},
line_of_credit_accounts_open_count bigint, line_of_credit_accounts_open_total bigint, line_of_credit_accounts_open {_PAIR},
miscellaneous_accounts_open_count bigint, miscellaneous_accounts_open_total bigint, miscellaneous_accounts_open {_PAIR},
inquiries_last_6_months int, inquiries_6mo int, monthly_payments bigint, late_pays_2yr int, late_pays_gt2yr int,
late_pays struct<last_2_years: int, last_over_2_years: int>, credit_freeze int, fraud_alert int, deceased int,
credit_card_open_totals {_CARD}, credit_card_open_totals_no_retail {_CARD},
credit_factors array<struct<factor: string, color: string, hex: string>>
"""


def parse_report_text(df: DataFrame, text: str, report_id: str) -> DataFrame:
    """Reports from whole-file texts: dates without quotes are repaired, a ``rec`` wrapper is
    removed, and a JSON ``null`` gives no row. A text that still does not parse raises."""
    fixed = F.regexp_replace(text, r'"date"\s*:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', r'"date": "$1"')
    fixed = F.regexp_replace(fixed, r'"payment"\s*:', '"Payment":')
    options = {"mode": "FAILFAST"}
    plain = F.from_json("_t", REPORT, options)
    inner = F.from_json(F.get_json_object("_t", "$.rec"), REPORT, options)
    wrapped = F.get_json_object("_t", "$.rec").isNotNull()
    rows = df.select(F.col(report_id).alias("report_id"), fixed.alias("_t")).where(F.trim("_t") != "null")
    return rows.select("report_id", F.when(wrapped, inner).otherwise(plain).alias("r")).where(
        F.col("r").isNotNull()).select("report_id", "r.*")


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file; the file name is the report id."""
    raw = spark.read.text(path, wholetext=True).withColumn("_f", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return parse_report_text(raw, "value", "_f")


def clean_address(c: Column) -> Column:
    """Address text without doubled commas, blanks and a comma before the ZIP."""
    s = F.regexp_replace(c, r"[, ]+$", "")
    s = F.regexp_replace(s, r",(\s*,)+", ",")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.regexp_replace(s, r",\s*(\d{5})$", " $1")


def normalize_aliases(df: DataFrame) -> DataFrame:
    """Alternate spellings and nested forms of report fields to the one flat form."""
    c = F.col
    first = F.coalesce
    score, address = c("credit_score"), c("address")
    nested_score = F.schema_of_variant(score).startswith("OBJECT")
    card = first("credit_card_open_totals", "credit_card_open_totals_no_retail")
    out = {
        "source": first("pdf_file", "source"),
        "filename": first(F.element_at(F.split("pdf_file", "/"), -1), c("filename")),
        "credit_score": F.when(nested_score, F.try_variant_get(score, "$.value", "int")).otherwise(
            F.try_variant_get(score, "$", "int")),
        "credit_score_color": F.when(nested_score, F.try_variant_get(score, "$.color", "string")).otherwise(
            c("credit_score_color")),
        "address": F.transform(first(
            F.try_variant_get(address, "$", "array<string>"),
            F.when(F.schema_of_variant(address) == "STRING", F.array(F.try_variant_get(address, "$", "string"))),
            F.array().cast("array<string>")), clean_address),
        "collections_open": first("collections_open", "collections_open_count", "collections.open"),
        "collections_closed": first("collections_closed", "collections_closed_count", "collections.closed"),
        "inquiries_last_6_months": first("inquiries_last_6_months", "inquiries_6mo"),
        "late_pays_2yr": first("late_pays.last_2_years", "late_pays_2yr"),
        "late_pays_gt2yr": first("late_pays.last_over_2_years", "late_pays_gt2yr"),
        "credit_card_open_totals": F.when(card.isNotNull(), F.struct(
            card["color"].alias("color"), card["hex"].alias("hex"), card["balance"].alias("balance"),
            card["limit"].alias("limit"), first(card["Percent"], card["utilization_percent"]).alias("Percent"),
            card["Payment"].alias("Payment"))),
    }
    for nested, flat in (("revolving_accounts_open", "revolving_open"), ("installment_accounts_open", "installment_open"),
                         ("real_estate_open", "real_estate_open"), ("line_of_credit_accounts_open", "line_of_credit_accounts_open"),
                         ("miscellaneous_accounts_open", "miscellaneous_accounts_open")):
        out[f"{flat}_count"] = first(c(f"{flat}_count"), c(f"{nested}.count"))
        out[f"{flat}_total"] = first(c(f"{flat}_total"), c(f"{nested}.amount"))
    for color in ("red", "green", "black"):
        mine = F.filter(F.transform("credit_factors", lambda f: f["color"]), lambda x: x == F.lit(color))
        out[f"{color}_credit_factors_count"] = F.when(c("credit_factors").isNotNull(), F.size(mine))
    drop = ["pdf_file", "collections", "collections_open_count", "collections_closed_count", "inquiries_6mo",
            "late_pays", "credit_card_open_totals_no_retail", "revolving_accounts_open", "installment_accounts_open",
            "real_estate_open", "line_of_credit_accounts_open", "miscellaneous_accounts_open"]
    return df.withColumns(out).drop(*drop)


QA_LOG = ("pdf string, timestamp string, phrases map<string, struct<color: string, text: string, hex: string, "
          "page: int, found: boolean, expected: string, match: boolean>>")


def explode_checks(df: DataFrame) -> DataFrame:
    """One row per (document, phrase) of a phrase-check log."""
    return df.select("pdf", "timestamp", F.explode("phrases").alias("phrase", "v")).select("pdf", "timestamp", "phrase", "v.*")


def read_check_log(spark: SparkSession, path: str) -> DataFrame:
    return explode_checks(spark.read.schema(QA_LOG).json(path))


def match_rates(checks: DataFrame, by: list[str]) -> DataFrame:
    """Share of phrases whose found colour is the expected one."""
    return checks.groupBy(*by).agg(
        F.count("*").alias("n_phrases"), F.count_if("found").alias("n_found"), F.count_if("match").alias("n_match"),
        F.avg(F.coalesce(F.col("match"), F.lit(False)).cast("int")).alias("match_rate"))


def parse_expectations(lines: DataFrame) -> DataFrame:
    """(document, phrase, color) from expectation texts.

    ``lines`` has file, line_no (dense) and text. ``PDF file:`` names the current document,
    ``Credit Factors`` opens a section, ``- [color] phrase`` lines inside it count, and a blank
    line closes it. A phrase named twice keeps its last colour.
    """
    t = F.col("text")
    low = F.lower(t)
    is_doc = low.startswith("pdf file:")
    opens = ~is_doc & F.lower(F.trim(t)).startswith("credit factors")
    item = r"^\s*[-•]\s*\[(\w+)\]\s*(.+)$"
    name = F.element_at(F.split(F.trim(F.regexp_replace(t, r"(?i)^pdf file:", "")), "/"), -1)
    state = F.when(opens, True).when(~is_doc & (F.trim(t) == ""), False)
    # Only what a line says goes through the scan: its texts are not carried and sorted with it.
    said = lines.select(
        "file", "line_no", chunk_of("line_no").alias("_piece"), F.when(is_doc, name).alias("_names"), state.alias("_state"),
        F.when(t.rlike(item) & ~opens, F.struct(F.trim(F.regexp_extract(t, item, 2)).alias("phrase"), F.lower(F.regexp_extract(t, item, 1)).alias("color"))).alias("_item"))
    scanned = prefix_scan(
        said, ["file"], "_piece", ["line_no"], {"document": ("last", F.col("_names"), True), "_open": ("last", F.col("_state"), True)})
    hits = scanned.where(F.col("document").isNotNull() & F.col("_open") & F.col("_item").isNotNull())
    rows = hits.select("file", "line_no", "document", "_item.phrase", "_item.color")
    return rows.groupBy("document", "phrase").agg(F.max_by("color", F.struct("file", "line_no")).alias("color"))


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Expectation files; each file is one row until its lines are numbered."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = raw.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "text"))
    return parse_expectations(lines)
