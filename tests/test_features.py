import json

import pytest

from creditloom.plans.column_schema import ColumnSpec, default_schema, load_schema, model_flag, resolve_roles
from creditloom.plans.feature_table import feature_table, flatten_records, freeze_labels, merge_medians
from creditloom.sources.applications import parse_records, read_envelope, read_records


def offer(name, **kw):
    return {"Name": name, "Score": 653, "Status": "Approved", "Amount": "$12,000", "Details": "d", "Contingencies": "",
            "DebtToIncome": 17, **kw}


def record(i, offers, contracts=(), dti=17):
    return {"record_id": str(i), "user_initials": f"U{i % 2}",
            "prefi_data": {"Offers": offers, "DataEnhance": {"DebtToIncome": dti}}, "contracts": list(contracts)}


def contract(status, tier, amount, at):
    return {"status": status, "tier": tier, "amount": amount, "created_at": at}


RECORDS = [
    record(1, [offer("Automatic Financing"), offer("0% Unsecured Funding", Contingencies="PayD-$20,000,Collections-$5,700"),
               offer("Debt Resolution")],
           [contract("declined", None, "1.00", "2024-01-01T00:00:00-05:00"),
            contract("approved", "0.24", "12000.00", "2024-11-19T00:00:00-05:00")]),
    record(2, [offer("Automatic Financing", Score=550), offer("Automatic Financing", Score="Below 600", Amount="")]),
    record(3, [offer("Automatic Financing", Score="550"), {"Score": 1},
               offer("Debt Resolution", Score=None, DebtToIncome=None, Status="")],
           [contract("approved", "0.34", "5", "2024-01-01T00:00:00Z"), contract("declined", "0.51", "7", "2024-01-01T00:00:00Z")]),
    record(4, [offer("0% Unsecured Funding", Status="NA", Contingencies="PayD-$100, Collections-$50", Amount=None)]),
    record(5, []),
]


def flat(spark, records=RECORDS, loose=False):
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "line string")
    return {int(r["record_id"]): r for r in flatten_records(parse_records(lines, "line", loose)).collect()}


def test_flatten(spark):
    r = flat(spark)
    assert r[1]["0UnsecuredFunding_PayD"] == 20000 and r[1]["0UnsecuredFunding_Collections"] == 5700
    assert (r[1]["final_contract_status"], r[1]["final_contract_tier"], r[1]["final_contract_amount"]) == ("approved", 0.24, 12000)
    assert (r[2]["AutomaticFinancing_Score"], r[2]["AutomaticFinancing_below_600_"], r[2]["AutomaticFinancing_Amount"]) == (599, 1, 0)
    assert (r[3]["AutomaticFinancing_Score"], r[3]["AutomaticFinancing_below_600_"]) == (550, 0)
    assert (r[3]["DebtResolution_Score"], r[3]["DebtResolution_DebtToIncome"], r[3]["DebtResolution_score_missing_"]) == (-999, -999, 1)
    assert r[3]["DebtResolution_Status"] == "Declined"
    assert r[3]["final_contract_status"] == "approved"  # equal dates keep the first contract
    assert (r[4]["0UnsecuredFunding_Status"], r[4]["0UnsecuredFunding_PayD"], r[4]["0UnsecuredFunding_Collections"]) == ("Declined", 100, 50)
    assert r[5]["final_contract_status"] is None
    assert (r[5]["AutomaticFinancing_missing_"], r[5]["AutomaticFinancing_Score"], r[5]["0UnsecuredFunding_Contingencies"]) == (1, -1, "-1")


def test_loose_offers_skip_junk(spark):
    bad = [record(1, [offer("Automatic Financing"), "junk", 3])]
    assert flat(spark, bad, loose=True)[1]["AutomaticFinancing_Score"] == 653
    with pytest.raises(Exception):
        flat(spark, bad)


def test_feature_table(spark):
    lines = spark.createDataFrame([(json.dumps(r),) for r in RECORDS], "line string")
    out = feature_table(flatten_records(parse_records(lines, "line")), default_schema(), check=False)
    rows = {int(r["record_id"]): r for r in out.collect()}
    assert "0UnsecuredFunding_Score" not in out.columns and "DebtResolution_DebtToIncome" not in out.columns
    assert rows[1]["final_contract_status_label"] == 0 and rows[1]["final_contract_tier_label"] == 1
    assert rows[5]["final_contract_status_label"] == -1
    hot = [c for c in out.columns if "_Status_" in c]
    assert hot and all(dict(out.dtypes)[c] == "int" for c in hot)
    assert {rows[i][c] for i in rows for c in hot} <= {0, 1}
    assert rows[1]["Merged_DebtToIncome"] == 17


def test_frozen_labels_agree(spark):
    records = [record(i, [], []) for i in range(1, 13)]
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "line string")
    f = flatten_records(parse_records(lines, "line"))
    direct = {r[0]: r[1] for r in feature_table(f, default_schema()).select("record_id", "user_initials_label").collect()}
    frozen = {r[0]: r[1] for r in feature_table(f, freeze_labels(f, default_schema())).select("record_id", "user_initials_label").collect()}
    assert direct == frozen and set(direct.values()) == {0, 1}


def test_score_merge(spark):
    df = spark.createDataFrame([(700.0, 650.0), (None, 600.0), (-1.0, -1.0)], "AutomaticFinancing_Score double, `0UnsecuredFunding_Score` double")
    out = merge_medians(df, default_schema())
    assert [r[0] for r in out.collect()] == [675.0, 600.0, -1.0] and out.columns == ["AutomaticFinancing_Score"]


def test_files(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.json").write_text(json.dumps({"generated_at": "x", "summary": {}, "data": RECORDS}, indent=1))
    (tmp_path / "e" / "b.json").write_text(json.dumps({"generated_at": "x"}))
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in RECORDS))
    assert read_envelope(spark, str(tmp_path / "e")).count() == 5
    assert read_records(spark, str(tmp_path / "l.json")).count() == 5
    (tmp_path / "bad.json").write_text('{"record_id": ')
    with pytest.raises(Exception):
        read_records(spark, str(tmp_path / "bad.json")).collect()


SCHEMA = [
    {"name": "a", "X": "True", "use_XGB": True}, {"name": "b", "X": "True"}, {"name": "b", "Y": "False", "categorical": "True"},
    {"name": "t", "Y": "True"}, {"name": "s_Status", "X": "True", "ohe": {"v": "s_Status_v"}},
    {"name": "s_Status_v", "X": "True", "ohe_from": "s_Status", "ohe_key": "v"},
]


def test_roles():
    specs = load_schema(SCHEMA)
    cols = ["a", "b", "t", "s_Status", "s_Status_v"]
    r = resolve_roles(specs, cols)
    assert r.features == ["a", "b", "s_Status_v"] and r.categorical == ["b"] and r.target("T") == "t"
    assert resolve_roles(specs, cols, "XGBClassifier").features == ["a"]
    assert resolve_roles(specs, cols, "SVM").features == ["a", "b", "s_Status_v"]
    with pytest.raises(ValueError):
        resolve_roles(specs, ["a", "t"])
    assert resolve_roles(specs, ["a", "t"], allow_missing=True).features == ["a"]
    assert model_flag("RandomForestClassifier") == "RF" and isinstance(specs[0], ColumnSpec)


def test_frozen_labels_of_nulls_and_unseen_values(spark):
    from creditloom.plans.column_schema import AUTO, ColumnSpec
    from creditloom.plans.feature_table import encode

    train = spark.createDataFrame([(None,)] * 9 + [("a",)] * 8 + [("lonely",)], "v string")
    specs = [ColumnSpec("v", labels=AUTO, methods=["grouped", "frequency"]), ColumnSpec("label", labels_from="v")]
    direct = {r.v: r.label for r in encode(train, specs).collect()}
    new = spark.createDataFrame([(None,), ("a",), ("lonely",), ("never seen",)], "v string")
    frozen = {r.v: r.label for r in encode(new, freeze_labels(train, specs)).collect()}
    assert {v: frozen[v] for v in direct} == direct and frozen["never seen"] == direct["lonely"]
    plain = freeze_labels(train, [ColumnSpec("v", labels=AUTO, methods=["frequency"]), specs[1]])
    assert {r.v: r.label for r in encode(new, plain).collect()}["never seen"] == -1
    many = spark.range(3000).selectExpr("cast(id as string) v")
    assert encode(many, freeze_labels(many, [ColumnSpec("v", labels=AUTO, methods=["frequency"]), specs[1]])).select("label").distinct().count() == 3000


def test_only_the_last_offer_of_a_type_is_cleaned(spark):
    from creditloom.plans.feature_table import clean_offers, last_offers

    given = [offer("Automatic Financing", Score=1), {"Score": 1}, offer("Other"), offer("Debt Resolution", Score="Below 600"), offer("Automatic Financing", Amount="$1,5 ")]
    df = parse_records(spark.createDataFrame([(json.dumps(record(1, given)),), (json.dumps(record(2, None)),)], "line string"), "line")
    got = [r.o for r in df.select(clean_offers(last_offers(df["prefi_data.Offers"])).alias("o")).collect()]
    assert [o and (o.name, o.score, o.low, o.amount) for o in got[0]] == [("AutomaticFinancing", 653, 0, 15), None, ("DebtResolution", 599, 1, 12000)]
    assert got[1] is None or got[1] == [None, None, None]
