"""Records, numeric and label queries. Application records are built from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.catalog.tables import table
from creditloom.functions import labels as L
from creditloom.functions.numeric import as_flag, clean_numeric, number_or, row_median
from creditloom.operators import filters
from creditloom.operators.autolabel import auto_labels
from creditloom.operators.sizing import settle
from creditloom.plans import feature_table as ft
from creditloom.plans.column_schema import AUTO, TIER_LABELS, ColumnSpec, default_schema
from creditloom.sources.applications import parse_records

# One application per order: its lines are the offers, A/N/R being the three offer types.
OFFER_JSON = """
concat('{"Name":"', case l_returnflag when 'A' then 'Automatic Financing' when 'N' then '0% Unsecured Funding'
  else 'Debt Resolution' end, '","Score":',
  case l_linenumber % 5 when 0 then '"Below 600"' when 1 then cast(550 + cast(l_quantity as int) as string)
    when 2 then concat('"', 550 + cast(l_quantity as int), '"') when 3 then 'null'
    else cast(590 + cast(l_quantity as int) as string) end,
  ',"Status":"', case when l_tax = 0 then '' when l_linestatus = 'O' then 'Declined'
    when l_returnflag = 'N' then 'As Is' else 'Approved' end,
  '","Amount":"$', cast(floor(l_extendedprice / 1000) as bigint), ',',
  lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as string), 3, '0'),
  '","DebtToIncome":', case when l_discount = 0.05 then 'null' else cast(cast(round(l_discount * 100) as int) as string) end,
  ',"Contingencies":"', case when l_linenumber = 7 then '' when l_linenumber % 2 = 0
    then concat('PayD-$', cast(l_quantity as int), ',000,Collections-$', l_suppkey)
    else concat('PayD-$', l_partkey) end, '"}')
"""
# Signs that occur in no offer, and what each stands for. Offers sort alike with either: the signs are below all text,
# and those of the names are in the names' order.
OFFER_PARTS = dict(zip("\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10", [
    '{"Name":"', "0% Unsecured Funding", "Automatic Financing", "Debt Resolution", '","Score":', ',"Status":"', '","Amount":"$',
    '","DebtToIncome":', ',"Contingencies":"', "PayD-$", ",000,Collections-$"]))
CONTRACT_JSON = """
case when o_orderkey % 10 = 0 then '[]' else concat(
  '[{"status":"declined","tier":null,"amount":"1.00","created_at":"', date_format(o_orderdate, 'yyyy-MM-dd'),
  'T00:00:00+00:00"},{"status":"', case o_orderstatus when 'O' then 'approved' when 'F' then 'declined' else 'rejected' end,
  '","tier":"', case substring(o_orderpriority, 1, 1) when '1' then '0.045' when '2' then '0.24' when '3' then '0.34'
    when '4' then '0.44' else '0.99' end,
  '","amount":"', cast(cast(floor(o_totalprice) as bigint) as string), '.00","created_at":"',
  date_format(date_add(cast(o_orderdate as date), cast(o_orderkey % 3 - 1 as int)), 'yyyy-MM-dd'), 'T00:00:00+00:00"}]') end
"""


def application_text(spark: SparkSession, sf: str, shorten: bool = False) -> DataFrame:
    """One JSON text per order. With ``shorten`` the offers' fixed parts go through the shuffle as single signs; the texts are
    the same, but fewer bytes are dealt otherwise over tasks, and trees that learn from the records draw by that."""
    short, parts = OFFER_JSON, OFFER_PARTS if shorten else {}
    for sign, part in parts.items():
        short = short.replace(f"'{part}", f"'{sign}")
    offers = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr(short).alias("j")).alias("s"),
    ).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("s"))  # compiled, unlike array_sort
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderkey") % 40).alias("dti"), F.expr(CONTRACT_JSON).alias("contracts")
    ).repartition("o_orderkey")
    given = F.array_join("s.j", ",")
    for sign, part in parts.items():
        given = F.replace(given, F.lit(sign), F.lit(part))
    body = F.concat(
        F.lit('{"record_id":"'), F.col("o_orderkey"), F.lit('","user_initials":"U'), F.col("o_custkey") % 60,
        F.lit('","prefi_data":{"Offers":['), F.coalesce(given, F.lit("")),
        F.lit('],"DataEnhance":{"DebtToIncome":'), F.col("dti"), F.lit('}},"contracts":'), F.col("contracts"), F.lit("}"),
    )
    return orders.join(offers, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(body.alias("line"))


def flat_records(spark, sf, shorten: bool = False) -> DataFrame:
    return ft.flatten_records(parse_records(application_text(spark, sf, shorten), "line"))


# SQL twin of the record builder: the last line per offer type and order.
LAST_OFFER = """
last_offer as (
  select * from (
    select *, row_number() over (partition by l_orderkey, l_returnflag
      order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) rn from lineitem) where rn = 1),
offer as (
  select l_orderkey, l_returnflag,
    case l_linenumber % 5 when 0 then 599.0 when 1 then 550 + l_quantity when 2 then 550 + l_quantity
      when 3 then null else 590 + l_quantity end raw_score,
    case when l_linenumber % 5 = 0 then 1 when l_linenumber % 5 = 1 and 550 + l_quantity < 600 then 1
      when l_linenumber % 5 = 4 and 590 + l_quantity < 600 then 1 else 0 end low,
    case when l_tax = 0 then case when l_returnflag = 'A' then 'NA' else 'Declined' end
      when l_linestatus = 'O' then 'Declined' when l_returnflag = 'N' then 'As Is' else 'Approved' end status,
    cast(floor(l_extendedprice) as double) amount,
    case when l_discount = 0.05 then null else round(l_discount * 100) end raw_dti,
    case when l_linenumber = 7 then 0.0 when l_linenumber % 2 = 0 then floor(l_quantity) * 1000 else l_partkey end payd,
    case when l_linenumber = 7 then 0.01 when l_linenumber % 2 = 0 then l_suppkey else 0.01 end coll
  from last_offer),
fixed as (
  select *, coalesce(raw_score, case when l_returnflag = 'R' and status = 'Declined' then -999.0 else -1.0 end) score,
    coalesce(raw_dti, case when l_returnflag = 'R' and status = 'Declined' then -999.0 else -1.0 end) dti,
    case when l_returnflag = 'R' and status = 'Declined' and raw_score is null then 1 else 0 end hidden
  from offer),
wide as (
  select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
    a.score a_score, n.score n_score, r.score r_score, a.low a_low, n.low n_low, r.low r_low,
    a.status a_status, n.status n_status, r.status r_status, a.amount a_amount, n.amount n_amount, r.amount r_amount,
    a.dti a_dti, n.dti n_dti, r.dti r_dti, n.payd, n.coll, r.hidden,
    a.l_orderkey is null a_miss, n.l_orderkey is null n_miss, r.l_orderkey is null r_miss
  from orders left join fixed a on a.l_orderkey = o_orderkey and a.l_returnflag = 'A'
  left join fixed n on n.l_orderkey = o_orderkey and n.l_returnflag = 'N'
  left join fixed r on r.l_orderkey = o_orderkey and r.l_returnflag = 'R')
"""
CONTRACT_SQL = """
  case when o_orderkey % 10 = 0 then null when o_orderkey % 3 = 2
    then case o_orderstatus when 'O' then 'approved' when 'F' then 'declined' else 'rejected' end else 'declined' end
"""
TIER_SQL = """
  case when o_orderkey % 10 = 0 then null when o_orderkey % 3 = 2
    then case substring(o_orderpriority, 1, 1) when '1' then 0.045 when '2' then 0.24 when '3' then 0.34
      when '4' then 0.44 else 0.99 end else -1.0 end
"""


def offer_pivot(spark, sf):
    return flat_records(spark, sf).select(
        F.col("record_id").cast("bigint").alias("record_id"),
        *[F.col(f"{p}_{s}").alias(f"{a}_{s.strip('_').lower()}") for p, a in
          (("AutomaticFinancing", "af"), ("0UnsecuredFunding", "uf"), ("DebtResolution", "dr"))
          for s in ("missing_", "Status", "Amount")],
    )


OFFER_PIVOT_SQL = f"""
with {LAST_OFFER}
select o_orderkey record_id,
  cast(a_miss as int) af_missing, coalesce(a_status, 'NA') af_status, coalesce(a_amount, -1.0) af_amount,
  cast(n_miss as int) uf_missing, coalesce(n_status, 'NA') uf_status, coalesce(n_amount, -1.0) uf_amount,
  cast(r_miss as int) dr_missing, coalesce(r_status, 'NA') dr_status, coalesce(r_amount, -1.0) dr_amount
from wide
"""


def threshold_flag(spark, sf):
    return flat_records(spark, sf).select(
        F.col("record_id").cast("bigint").alias("record_id"),
        *[F.col(f"{p}_{s}").alias(f"{a}_{n}") for p, a in
          (("AutomaticFinancing", "af"), ("0UnsecuredFunding", "uf"), ("DebtResolution", "dr"))
          for s, n in (("Score", "score"), ("below_600_", "below"))],
    )


THRESHOLD_SQL = f"""
with {LAST_OFFER}
select o_orderkey record_id, coalesce(a_score, -1.0) af_score, coalesce(a_low, -1) af_below,
  coalesce(n_score, -1.0) uf_score, coalesce(n_low, -1) uf_below, coalesce(r_score, -1.0) dr_score, coalesce(r_low, -1) dr_below
from wide
"""


def mnar_impute(spark, sf):
    return flat_records(spark, sf).select(
        F.col("record_id").cast("bigint").alias("record_id"), F.col("DebtResolution_score_missing_").alias("hidden"),
        F.col("DebtResolution_Score").alias("score"), F.col("DebtResolution_DebtToIncome").alias("dti"))


MNAR_SQL = f"""
with {LAST_OFFER}
select o_orderkey record_id, coalesce(hidden, -1) hidden, coalesce(r_score, -1.0) score, coalesce(r_dti, -1.0) dti from wide
"""


def contingency_regex(spark, sf):
    return flat_records(spark, sf).select(
        F.col("record_id").cast("bigint").alias("record_id"), F.col("0UnsecuredFunding_PayD").alias("payd"),
        F.col("0UnsecuredFunding_Collections").alias("collections"))


CONTINGENCY_SQL = f"""
with {LAST_OFFER}
select o_orderkey record_id, cast(coalesce(payd, -1) as double) payd, cast(coalesce(coll, -1) as double) collections from wide
"""


def contract_latest(spark, sf):
    return flat_records(spark, sf).select(
        F.col("record_id").cast("bigint").alias("record_id"), F.col("final_contract_status").alias("status"),
        F.col("final_contract_tier").alias("tier"), F.col("final_contract_amount").alias("amount"))


CONTRACT_LATEST_SQL = f"""
select o_orderkey record_id, {CONTRACT_SQL} status, cast({TIER_SQL} as double) tier,
  cast(case when o_orderkey % 10 = 0 then null when o_orderkey % 3 = 2 then floor(o_totalprice) else 1 end as double) amount
from orders
"""


def feature_table(spark, sf):
    # Two passes follow, one of them for label counts, so the parsed rows are written once.
    out = ft.feature_table(settle(flat_records(spark, sf)), default_schema())
    return out.select(
        F.col("record_id").cast("bigint").alias("record_id"), "user_initials", "user_initials_label",
        "DebtToIncome", "Merged_DebtToIncome", "AutomaticFinancing_Score", "DebtResolution_Score",
        "AutomaticFinancing_Amount", "0UnsecuredFunding_Amount", "DebtResolution_Amount", "final_contract_amount",
        "0UnsecuredFunding_missing_", "DebtResolution_missing_", "final_contract_status",
        "final_contract_status_label", "final_contract_tier_label", "AutomaticFinancing_Status",
        "AutomaticFinancing_Status_Approved", "AutomaticFinancing_Status_Declined", "0UnsecuredFunding_Status_As_Is",
        "0UnsecuredFunding_Status_NA", "DebtResolution_Status_Declined",
    )


FEATURE_SQL = f"""
with {LAST_OFFER},
ini as (select 'U' || (o_custkey % 60) v, count(*) k from orders group by 1),
grp as (select v, case when k < greatest(5, cast(floor(0.02 * (select count(*) from orders)) as bigint)) then 'other' else v end g, k from ini),
rnk as (select g, cast(row_number() over (order by sum(k) desc, g) - 1 as int) lab from grp group by g),
x as (
  select w.*, lab, {CONTRACT_SQL} st, {TIER_SQL} tier,
    list_sort(list_filter([coalesce(a_dti, -1.0), coalesce(n_dti, -1.0), coalesce(r_dti, -1.0), cast(o_orderkey % 40 as double)],
      lambda v: v <> -1 and v <> 0)) d,
    list_filter([coalesce(a_score, -1.0), coalesce(n_score, -1.0)], lambda v: v <> -1) s
  from wide w join grp on v = 'U' || (o_custkey % 60) join rnk using (g))
select o_orderkey record_id, 'U' || (o_custkey % 60) user_initials, lab user_initials_label,
  cast(o_orderkey % 40 as double) "DebtToIncome",
  cast(case len(d) when 0 then -1 else (d[(len(d) + 1) // 2] + d[len(d) // 2 + 1]) / 2 end as double) "Merged_DebtToIncome",
  cast(case len(s) when 0 then -1 when 1 then s[1] else (s[1] + s[2]) / 2 end as double) "AutomaticFinancing_Score",
  coalesce(r_score, -1.0) "DebtResolution_Score",
  coalesce(a_amount, -1.0) "AutomaticFinancing_Amount", coalesce(n_amount, -1.0) "0UnsecuredFunding_Amount",
  coalesce(r_amount, -1.0) "DebtResolution_Amount",
  cast(case when o_orderkey % 10 = 0 then 0 when o_orderkey % 3 = 2 then floor(o_totalprice) else 1 end as double) final_contract_amount,
  cast(n_miss as int) "0UnsecuredFunding_missing_", cast(r_miss as int) "DebtResolution_missing_",
  st final_contract_status,
  case when st in ('approved', 'rejected') then 0 when st = 'declined' then 1 else -1 end final_contract_status_label,
  case when tier is null then -1 when tier = 0.045 then 0 when tier = 0.24 then 1 when tier = 0.34 then 2 when tier = 0.44 then 3
    else -1 end final_contract_tier_label,
  coalesce(a_status, 'NA') "AutomaticFinancing_Status",
  case when a_status = 'Approved' then 1 else 0 end "AutomaticFinancing_Status_Approved",
  case when a_status = 'Declined' then 1 else 0 end "AutomaticFinancing_Status_Declined",
  case when n_status = 'As Is' then 1 else 0 end "0UnsecuredFunding_Status_As_Is",
  case when n_status is null then 1 else 0 end "0UnsecuredFunding_Status_NA",
  case when r_status = 'Declined' then 1 else 0 end "DebtResolution_Status_Declined"
from x
"""


def clean_numeric_q(spark, sf):
    text = F.expr(
        "case o_orderkey % 6 when 0 then concat(' $', cast(cast(floor(o_totalprice / 1000) as bigint) as string), ',', "
        "lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as string), 3, '0'), ' ') when 1 then 'N/A' when 2 then 'None' "
        "when 3 then concat(cast(o_custkey as string), '.5') when 4 then '' else concat(cast(o_custkey as string), 'd') end"
    )
    return table(spark, sf, "orders").select("o_orderkey", clean_numeric(text).alias("amount"),
                                             number_or(text, 0.0).alias("amount_or_zero"))


CLEAN_SQL = """
select o_orderkey, amount, coalesce(amount, 0.0) amount_or_zero from (
  select o_orderkey, case o_orderkey % 6 when 0 then cast(floor(o_totalprice) as double)
    when 3 then o_custkey + 0.5 else null end::double amount from orders)
"""


def json_props(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", k.cast("bigint").alias("k"), clean_numeric(k).alias("k_number"))


JSON_PROPS_SQL = """
select event_id, cast(json_extract_string(props, '$.k') as bigint) k, cast(json_extract_string(props, '$.k') as double) k_number from events
"""


def latest_per_key(spark, sf):
    o = table(spark, sf, "orders")
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"),
                    F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k")))
    return o.groupBy("o_custkey").agg(best.alias("x")).select("o_custkey", "x.*")


LATEST_SQL = """
select o_custkey, o_orderkey, o_orderstatus, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) rn from orders) where rn = 1
"""

PRIORITY = {"1-URGENT": "0", "2-HIGH": "1", "3-MEDIUM": "2"}
PRIORITY_TEXT = {"1-URGENT": "A - Tier 1", "2-HIGH": "A - Tier 2", "5-LOW": "B"}


def _labelled(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumns({"label": L.map_label(F.col("o_orderpriority"), PRIORITY),
                          "text": L.map_value(F.col("o_orderpriority"), PRIORITY_TEXT)})


def label_map(spark, sf):
    return _labelled(spark, sf).select("o_orderkey", "label")


def value_map(spark, sf):
    return _labelled(spark, sf).select("o_orderkey", "text")


def failed_map(spark, sf):
    return filters.failed_mappings(_labelled(spark, sf), "o_orderkey", "o_orderpriority", "label")


def tier_names(spark, sf):
    tier = F.element_at(F.array(*[F.lit(float(k)) for k in L.TIER_NAMES]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    o = table(spark, sf, "orders").withColumn("tier", tier)
    return o.select("o_orderkey", L.tier_name(F.col("tier"), o.schema["tier"].dataType).alias("name"),
                    L.map_label(F.col("tier"), TIER_LABELS, o.schema["tier"].dataType).alias("label"))


def _case(col: str, d: dict, default: str, quote: bool = True) -> str:
    q = lambda v: f"'{v}'" if quote else v
    return f"case {col} " + " ".join(f"when '{k}' then {q(v)}" for k, v in d.items()) + f" else {default} end"


_TIERS = list(L.TIER_NAMES.items())
TIER_NAMES_SQL = "select o_orderkey, case o_orderkey % 10 " + " ".join(
    f"when {i} then '{n}'" for i, (_, n) in enumerate(_TIERS)) + " end as name, case o_orderkey % 10 " + " ".join(
    f"when {i} then {TIER_LABELS[k]}" for i, (k, _) in enumerate(_TIERS)) + " end as label from orders"


def auto_label_grouped_frequency(spark, sf):
    return auto_labels(table(spark, sf, "part"), "p_brand", "label", ["grouped", "frequency"]).select("p_partkey", "label")


def frozen_label_table(spark, sf):
    """Labels made on two thirds of the orders, given to all of them: nulls, values that training never
    saw, and one rare value that makes up the group "other"."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, None).when(
        F.col("o_orderkey") == 3, "rare").when(F.col("o_orderkey") % 99 == 2, "unseen").otherwise(F.col("o_orderpriority")).alias("value"))
    train = o.where("o_orderkey % 3 = 0 or o_orderkey % 4 = 1").where("o_orderkey % 99 <> 2")
    schema = [ColumnSpec("value", labels=AUTO, methods=["grouped", "frequency"]), ColumnSpec("value_label", labels_from="value")]
    out = ft.encode(o, ft.freeze_labels(train, schema))
    return out.select("o_orderkey", F.col("value_label").alias("label"))


FROZEN_SQL = """
with o as (select o_orderkey k, case when o_orderkey % 17 = 0 then 'None' when o_orderkey = 3 then 'rare' when o_orderkey % 99 = 2 then 'unseen' else o_orderpriority end v from orders),
train as (select * from o where (k % 3 = 0 or k % 4 = 1) and k % 99 <> 2),
counted as (select v, count(*) n, case when count(*) < greatest(5, (select count(*) * 2 // 100 from train)) then 'other' else v end g from train group by v),
labels as (select g, row_number() over (order by sum(n) desc, g) - 1 as label from counted group by g)
select k o_orderkey, coalesce(l.label, (select label from labels where g = 'other'), -1)::int as label
from o left join counted c on c.v = o.v left join labels l on l.g = c.g
"""


def auto_label_frequency(spark, sf):
    return auto_labels(table(spark, sf, "orders"), "o_custkey", "label", ["frequency"]).select("o_orderkey", "label")


def auto_label_simple(spark, sf):
    return auto_labels(table(spark, sf, "customer"), "c_mktsegment", "label", ["simple"]).select("c_custkey", "label")


def auto_label_grouped(spark, sf):
    return auto_labels(table(spark, sf, "customer"), "c_nationkey", "label", ["grouped"], 0.042).select("c_custkey", "label")


GROUPED_FREQUENCY_SQL = """
with v as (select p_brand, count(*) k from part group by 1),
g as (select p_brand, case when k < greatest(5, cast(floor(0.02 * (select count(*) from part)) as bigint)) then 'other' else p_brand end g, k from v),
r as (select g, cast(row_number() over (order by sum(k) desc, g) - 1 as int) label from g group by g)
select p_partkey, label from part join g using (p_brand) join r using (g)
"""
FREQUENCY_SQL = """
with r as (select o_custkey, cast(row_number() over (order by count(*) desc, cast(o_custkey as varchar)) - 1 as int) label from orders group by 1)
select o_orderkey, label from orders join r using (o_custkey)
"""
SIMPLE_SQL = "select c_custkey, cast(dense_rank() over (order by c_mktsegment) - 1 as int) as label from customer"
GROUPED_SQL = """
select c_custkey, case when count(*) over (partition by c_nationkey) < greatest(5, cast(floor(0.042 * (select count(*) from customer)) as bigint))
  then 'other' else cast(c_nationkey as varchar) end as label from customer
"""


def one_hot(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey", *[L.one_hot(s, v).alias(f"is_{v.lower()}") for v in "OFP"],
        as_flag(F.when(s == "O", "1").when(s == "F", "NA").otherwise("x")).alias("flag"))


ONE_HOT_SQL = """
select o_orderkey, cast(o_orderstatus = 'O' as int) is_o, cast(o_orderstatus = 'F' as int) is_f, cast(o_orderstatus = 'P' as int) is_p,
  cast(o_orderstatus = 'O' as int) flag from orders
"""


def row_median_q(spark, sf):
    c = lambda n: F.when(F.col(n) == 0, -1.0).otherwise(F.col(n))
    cols = [F.col("l_quantity"), c("l_discount"), c("l_tax"), F.col("l_linenumber").cast("double")]
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(row_median(cols), 6).alias("median4"), F.round(row_median(cols[1:3]), 6).alias("median2"))


ROW_MEDIAN_SQL = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(coalesce(list_median(list_filter([l_quantity, l_discount, l_tax, cast(l_linenumber as double)], lambda v: v <> 0)), -1), 6) median4,
  round(coalesce(list_median(list_filter([l_discount, l_tax], lambda v: v <> 0)), -1), 6) median2 from lineitem
"""


def schema_align(spark, sf):
    c = table(spark, sf, "customer").withColumn("seg_Status", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    names = ["c_custkey", "c_acctbal", "bureau_Score", "bureau_Name", "seg_Status", "extra_flag", "c_name"]
    full = ft.add_sentinels(c, [n for n in names if n != "extra_flag"])
    return ft.drop_text(ft.clean_text_columns(ft.align(full, names)))


SCHEMA_ALIGN_SQL = """
select c_custkey, c_acctbal, -1.0::double "bureau_Score", 'NA' "bureau_Name",
  case when c_mktsegment = 'MACHINERY' then 'NA' else c_mktsegment end "seg_Status", 0 extra_flag from customer
"""


def clean_names(spark, sf):
    raw = F.expr("case p_partkey % 4 when 0 then '0% Unsecured Funding' when 1 then 'Debt Resolution_score_missing?' "
                 "else concat(p_name, '?', p_brand) end")
    return table(spark, sf, "part").select("p_partkey", L.sanitize_value(raw).alias("name"))


CLEAN_NAMES_SQL = """
select p_partkey, case p_partkey % 4 when 0 then '0UnsecuredFunding' when 1 then 'DebtResolution_score_missing_'
  else regexp_replace(p_name || '?' || p_brand, '[^a-zA-Z0-9_]', '_', 'g') end as name from part
"""


def valid_target(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    tier = F.expr("case when quality is null then null when toxic = 1 then 'NA' when n_chars % 7 = 0 then '-1' "
                  "when n_chars % 7 = 1 then '' else cast(quality as string) end")
    return filters.valid_tier_rows(d.withColumn("tier", tier), "tier").select("doc_id", "tier")


VALID_TARGET_SQL = """
select doc_id, tier from (select doc_id, case when quality is null then null when toxic = 1 then 'NA' when n_chars % 7 = 0 then '-1'
  when n_chars % 7 = 1 then '' else cast(quality as varchar) end tier from documents left join labels using (doc_id))
where tier is not null and lower(tier) not in ('na', '-1', '', 'null', 'none')
"""


def labelled_rows(spark, sf):
    return filters.labelled_rows(_labelled(spark, sf), "label").select("o_orderkey", "label")


def non_finite(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("ratio", F.try_divide("l_tax", "l_discount")).withColumn(
        "gap", F.when(F.col("l_tax") == 0.01, F.lit(float("nan"))).when(F.col("l_tax") == 0.02, F.lit(float("inf"))).otherwise(1.0))
    return filters.non_finite_rows(li, ["ratio", "gap"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def one_hot_argmax(spark, sf):
    p = F.array(F.lit(0.2), F.col("l_discount") * 5, F.lit(0.8) - F.col("l_discount") * 5)
    hot = F.array(*[F.when(F.col("l_returnflag") == v, 1.0).otherwise(0.0) for v in "ANR"])
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", L.vector_to_label(hot).alias("hot"),
        L.vector_to_label(p).alias("soft"), L.vector_to_label(F.array(F.lit(1.0), F.lit(1.0))).alias("multi"))


ARGMAX_SQL = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end hot,
  case when 0.2 >= l_discount * 5 and 0.2 >= 0.8 - l_discount * 5 then 0 when l_discount * 5 >= 0.8 - l_discount * 5 then 1 else 2 end soft,
  null multi from lineitem
"""


def class_decode(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", L.status_name(F.col("o_orderkey") % 2).alias("status"),
                    L.tier_text(F.col("o_orderkey") % 7).alias("tier"))


CLASS_DECODE_SQL = """
select o_orderkey, case when o_orderkey % 2 = 0 then 'approved' else 'declined' end status,
  'Tier ' || case when o_orderkey % 7 < 4 then o_orderkey % 7 + 1 else o_orderkey % 7 end tier from orders
"""

QUERIES = {
    "feature_table": (feature_table, FEATURE_SQL),
    "offer_pivot": (offer_pivot, OFFER_PIVOT_SQL),
    "threshold_flag": (threshold_flag, THRESHOLD_SQL),
    "mnar_impute": (mnar_impute, MNAR_SQL),
    "contingency_regex": (contingency_regex, CONTINGENCY_SQL),
    "contract_latest": (contract_latest, CONTRACT_LATEST_SQL),
    "clean_numeric": (clean_numeric_q, CLEAN_SQL),
    "json_props": (json_props, JSON_PROPS_SQL),
    "latest_per_key": (latest_per_key, LATEST_SQL),
    "label_map": (label_map, f"select o_orderkey, {_case('o_orderpriority', PRIORITY, '-1', False)} as label from orders"),
    "value_map": (value_map, f"select o_orderkey, {_case('o_orderpriority', PRIORITY_TEXT, repr('NA'))} as text from orders"),
    "failed_map": (failed_map, f"select o_orderkey, o_orderpriority as original, -1 as label from orders where {_case('o_orderpriority', PRIORITY, '-1', False)} = -1"),
    "tier_name_map": (tier_names, TIER_NAMES_SQL),
    "auto_label_grouped_frequency": (auto_label_grouped_frequency, GROUPED_FREQUENCY_SQL),
    "frozen_label_table": (frozen_label_table, FROZEN_SQL),
    "auto_label_frequency": (auto_label_frequency, FREQUENCY_SQL),
    "auto_label_simple": (auto_label_simple, SIMPLE_SQL),
    "auto_label_grouped": (auto_label_grouped, GROUPED_SQL),
    "one_hot": (one_hot, ONE_HOT_SQL),
    "row_median": (row_median_q, ROW_MEDIAN_SQL),
    "schema_align": (schema_align, SCHEMA_ALIGN_SQL),
    "clean_names": (clean_names, CLEAN_NAMES_SQL),
    "valid_target": (valid_target, VALID_TARGET_SQL),
    "labelled_rows": (labelled_rows, f"select * from (select o_orderkey, {_case('o_orderpriority', PRIORITY, '-1', False)} as label from orders) where label >= 0"),
    "non_finite_rows": (non_finite, "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_discount = 0 or l_tax in (0.01, 0.02)"),
    "one_hot_argmax": (one_hot_argmax, ARGMAX_SQL),
    "class_decode": (class_decode, CLASS_DECODE_SQL),
}

