import json

from pyspark.sql import functions as F

from creditloom.functions import color as K
from creditloom.functions import text as X
from creditloom.operators import lines as L
from creditloom.operators import report_diff as D
from creditloom.plans import report_rows as R
from creditloom.sources import reports as S
from creditloom.sources import tables as T

RED, GREEN, BLACK = [220, 53, 69], [66, 143, 78], [33, 37, 41]
LEFT = [
    ("Name: A B", BLACK), ("Age: 40", BLACK), ("12 Oak st", BLACK), ("Aurora, co 80014", BLACK), ("720", GREEN),
    ("Collections (Open/Closed)", BLACK), ("2 / 1", RED), ("Public Records", BLACK), ("Bankruptcy CH-7  Discharged - 3/6/2021", RED),
    ("Inquires (Last 6 Months)", BLACK), ("4", RED), ("Late Pays (Last 2/2+ Years)", BLACK), ("3 / 5", RED),
    ("Credit Freeze", BLACK), ("Yes", RED), ("$1,234/mo", GREEN), ("Revolving", BLACK), ("10 / $56,881", BLACK),
    ("Credit Card Open Totals", BLACK), ("$5,000", GREEN), ("$10,000 50%", BLACK), ("$120", BLACK),
]
RIGHT = [("2 Rev Lates in 0-3 mo", RED), ("Seasoned closed accounts", GREEN), ("Avg age open 4 yrs", BLACK),
         ("Current Lates CITI now", RED), ("Paid Off 200k+ RE/RE", GREEN)]


def lines(spark):
    rows = []
    for i, (t, c) in enumerate(LEFT + RIGHT):
        x = 10.0 if i < len(LEFT) else 400.0
        box = [x, float(i), x + 50, i + 8.0]
        rows.append(("r1", 0, i, t, box, [(t, c, box)]))
    return spark.createDataFrame(rows, "report_id string, page int, pos bigint, text string, bbox array<double>, "
                                       "spans array<struct<text:string,rgb:array<int>,bbox:array<double>>>")


def test_report_row(spark):
    r = R.report_rows(lines(spark)).first()
    assert (r.credit_score, r.credit_score_color, r.age, list(r.address)) == (720, "green", 40, ["12 Oak St, Aurora, CO 80014"])
    assert (r.collections_open, r.collections_closed, r.public_records, r.inquiries_last_6_months) == (2, 1, 1, 4)
    assert (r.public_records_details["detail"], r.public_records_details["date"]) == ("Bankruptcy CH-7Discharged", "2021-03-06")
    assert (r.late_pays_2yr, r.late_pays_gt2yr, r.credit_freeze, r.fraud_alert, r.monthly_payments) == (3, 5, 1, 0, 1234)
    assert (r.revolving_open_count, r.revolving_open_total) == (10, 56881)
    card = r.credit_card_open_totals
    assert (card["balance"], card["limit"], card["Percent"], card["Payment"], card["color"]) == (5000, 10000, 50, 120, "green")
    got = {f["factor"]: f["color"] for f in r.credit_factors}
    assert got["2 Rev Lates in 0-3 mo"] == "red" and got["Seasoned closed accounts"] == "green"
    assert got["Paid Off 200k+ RE/RE"] == "green" and "Current Lates CITI now" in got
    assert r.red_credit_factors_count == sum(c == "red" for c in got.values())


def test_section_when_candidates_are_rejected(spark):
    texts = ["Credit Factors", "Charged off accts 2", "Light open rev depth", "Remarks", "after"]
    rows = [("r", 0, i, t, [0.0] * 4, [(t, RED, [10.0, 0.0, 20.0, 5.0])]) for i, t in enumerate(texts)]
    rows += [("r", 0, i + 5, f"{i},000 $5 $6", [0.0] * 4, [("", RED, [400.0, 0.0, 410.0, 5.0])]) for i in range(31)]
    df = spark.createDataFrame(rows, lines(spark).schema)
    got = {r.factor for r in R.report_factors(df).collect()}
    assert got == {"Charged off accts 2", "Light open rev depth"}


def test_addresses(spark):
    cases = [
        (["12 Oak st", "Aurora, co 80014"], ["12 Oak St, Aurora, CO 80014"]),
        (["1 Q rd", "2 B rd", "X, mi 48104", "Y, oh 43004"], ["1 Q Rd, X, MI 48104", "2 B Rd, Y, OH 43004"]),
        (["no street"], []), (["5 Elm ave"], ["5 Elm Ave"]),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<string>")
    got = {r.i: list(r.a) for r in df.select("i", R.pair_candidates(F.col("c")).alias("a")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    one = spark.createDataFrame([("12 LAKE of the woods, Mi. 48104 48104",)], "t string")
    assert one.select(X.postal_case(F.col("t"))).first()[0] == "12 Lake of the Woods, MI 48104"


def test_colors(spark):
    df = spark.createDataFrame([("#FF0000",), ("grey",), ("0f0",), ("",), (None,), ("123456",)], "c string")
    assert [r[0] for r in df.select(K.color_category(F.col("c"))).collect()] == ["red", "gray", "green", "unknown", "unknown", "other"]
    spans = spark.createDataFrame([([([0, 0, 0],), ([220, 53, 69],), ([10, 10, 10],)],), ([([250, 250, 250],)],), ([],)],
                                  "s array<struct<rgb:array<int>>>")
    got = spans.select(K.mean_span_color(F.col("s")).alias("m")).select("m", K.line_hex(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [([220, 53, 69], "#dc3545"), ([250, 250, 250], None), (None, None)]


def test_report_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rec": {"filename": "a", "credit_score": 700, "public_records_details": {"date": 2016-10-11}}}')
    (tmp_path / "b.json").write_text("null")
    (tmp_path / "c.json").write_text(json.dumps({"filename": "c", "late_pays": {"last_2_years": 1, "last_over_2_years": 2}}, indent=1))
    got = {r.filename: r for r in S.normalize_aliases(S.read_report_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a", "c"} and got["a"].credit_score == 700 and got["c"].late_pays_gt2yr == 2
    assert got["a"].public_records_details["date"] == "2016-10-11"


def test_expectations_and_logs(spark, tmp_path):
    (tmp_path / "x.txt").write_text("PDF file: d/u_1.pdf\nCredit Factors:\n- [Red] Late\n• [green] Good one\n\n- [red] outside\nPDF file: u_2.pdf\nCredit Factors\n- [Black] B\n")
    got = {(r.document, r.phrase): r.color for r in S.read_expectations(spark, str(tmp_path / "x.txt")).collect()}
    assert got == {("u_1.pdf", "Late"): "red", ("u_1.pdf", "Good one"): "green", ("u_2.pdf", "B"): "black"}
    log = {"pdf": "p", "timestamp": "t", "phrases": {"a": {"color": "red", "found": True, "expected": "red", "match": True},
                                                     "b": {"color": None, "found": False, "expected": "red", "match": False}}}
    (tmp_path / "q.jsonl").write_text(json.dumps(log) + "\n")
    rate = S.match_rates(S.read_check_log(spark, str(tmp_path / "q.jsonl")), ["pdf"]).first()
    assert (rate.n_phrases, rate.n_match, rate.match_rate) == (2, 1, 0.5)


def test_diffs(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "red")], "k int, open_count string, s_color string")
    b = spark.createDataFrame([(1, "x", "red"), (3, "y", None)], "k int, open_count string, s_color string")
    got = {(r.k, r.field, r.side) for r in D.field_mismatches(a, b, ["k"], ["open_count", "s_color"]).collect()}
    assert got == {(2, "open_count", "only_a"), (2, "s_color", "only_a"), (3, "open_count", "only_b"), (3, "s_color", "only_b")}


def test_csv_and_runs(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a b,n\nNA,1\n,2\nx,NA\n")
    text = T.sanitize_header(T.read_csv_text(spark, str(tmp_path / "t.csv")))
    assert text.columns == ["a_b", "n"] and [r.a_b for r in text.collect()] == ["NA", "", "x"]
    nulls = T.read_csv_nulls(spark, str(tmp_path / "t.csv"), "`a b` string, n int")
    assert [tuple(r) for r in nulls.collect()] == [(None, 1), (None, 2), ("x", None)]
    out = str(tmp_path / "runs")
    for ts, v in (("20240101-0000", 1), ("20240102-0000", 2)):
        T.write_split(spark.createDataFrame([(v, "train")], "v int, split string"), out, ts)
    assert [r.v for r in T.read_latest(spark, out).collect()] == [2]
    rep = str(tmp_path / "rep")
    T.write_report(spark.range(1), rep, "status", "test", "1")
    T.write_report(spark.range(3), rep, "status", "test", "2")
    assert T.read_latest_report(spark, rep, "status", "test").count() == 3


def _address(spark, *reports):
    rows = [(f"r{k}", 0, i, t, [0.0] * 4, [(t, BLACK, [0.0] * 4)]) for k, texts in enumerate(reports) for i, t in enumerate(texts)]
    got = {r.report_id: list(r.address) for r in R.report_fields(spark.createDataFrame(rows, lines(spark).schema)).collect()}
    return [got[f"r{k}"] for k in range(len(reports))]


def test_addresses_completed_from_the_whole_report(spark):
    far = ["filler"] * 12
    assert _address(
        spark,
        # Below an age line without a city: the first line with a city that holds number and name.
        ["Age: 40", "12 Oak st", "a", "b", "c", *far, "Former 12 Elm Oak st Lyons, co 80540", "12 Oak st Aurora, co 80014", "12 Oak st Dillon, co 80435"],
        # Parts of words count, and lines without a city do not.
        ["Age: 40", "12 Oak st", *far, "12 Oak st", "x912 Oakland, ca 94601"],
        # A city nearby comes first.
        ["Age: 40", "12 Oak st", "Dillon, co 80435", *far, "12 Oak st Aurora, co 80014"],
        # No age line: streets anywhere, near lines first, then the whole report.
        ["77 Pine ave", *far, "Vail, co 81657 for 77 Pine ave", *far, "8 Elm rd", "Lyons, co 80540"],
        # One word has no second one to look for, and nothing fits the other.
        ["Age: 40", "12 Oak st", *far, "12 Elm st Aurora, co 80014"],
    ) == [
        ["12 Oak St, Former 12 Elm Oak St Lyons, CO 80540"],
        ["12 Oak St, X912 Oakland, CA 94601"],
        ["12 Oak St, Dillon, CO 80435"],
        ["77 Pine Ave, Vail, CO 81657 for 77 Pine Ave", "8 Elm Rd, Lyons, CO 80540"],
        ["12 Oak St"],
    ]


def test_two_streets_without_a_city(spark):
    far = ["filler"] * 12
    one, two = _address(
        spark,
        ["Age: 40", "12 Oak St, 9 Elm Rd", *far, "Aurora, co 80014", "9 Elm Rd Dillon, co 80435"],
        ["Age: 40", "12 Oak St, 12 oak st", *far, "Aurora, co 80014"],
    )
    assert one == ["12 Oak St, Aurora, CO 80014", "9 Elm Rd, 9 Elm Rd Dillon, CO 80435"]
    assert two == ["12 Oak St, Aurora, CO 80014"]


def test_first_containing_line(spark):
    from creditloom.operators.matching import first_containing

    items = spark.createDataFrame([("a", 1, ["12", "Oak"]), ("a", 2, ["zz"]), ("a", 3, []), ("a", 4, ["é🦙", None, ""]), ("b", 1, ["12", "Oak"]), (None, 5, ["x"])],
                                  "r string, i int, t array<string>")
    found = spark.createDataFrame([("a", 9, "12 Oak"), ("a", 3, "Oak, 3124"), ("a", 1, "12 oak"), ("a", 5, None), ("a", 6, "xé🦙x"), ("b", 2, ""), ("c", 1, "12 Oak")],
                                  "r string, pos int, text string")
    got = {tuple(x) for x in first_containing(items.union(items), found, ["r"], ["i"], "t", "pos", "text").collect()}
    assert got == {("a", 1, 3, "Oak, 3124"), ("a", 4, 6, "xé🦙x")}
    kept = first_containing(items, found, ["r"], ["i"], "t", "pos", "text", unless=F.contains("text", F.lit(",")))
    assert {tuple(x) for x in kept.collect()} == {("a", 1, 9, "12 Oak"), ("a", 4, 6, "xé🦙x")}
    assert first_containing(items.where("false"), found, ["r"], ["i"], "t", "pos", "text").collect() == []


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_searched_once(spark):
    df = spark.createDataFrame([("No 5k+ lines",), ("a (b",), ("plain",), (None,)], "s string").select(F.concat("s", F.lit("~")).alias("t"))
    found = df.where(X.contains_any(F.col("t"), ["5K+ ".lower(), "(b"]))
    assert [r.t for r in found.collect()] == ["No 5k+ lines~", "a (b~"]
    assert _plan(found).split("Filter")[1].split("\n")[0].count("concat(") == 1


def test_nothing_found_is_not_cast(spark):
    from creditloom.functions.numeric import found_number, money

    df = spark.createDataFrame([("$1,200 x",), ("none",), ("$,",), (None,)], "t string")
    assert [r[0] for r in df.select(money(F.col("t"))).collect()] == [1200, None, None, None]
    assert [r[0] for r in spark.createDataFrame([("7",), ("",), ("x",)], "t string").select(found_number(F.col("t"))).collect()] == [7, None, None]


def test_texts_of_expectations_stay_out_of_the_scan(spark):
    df = spark.createDataFrame([("f", 0, "PDF file: a/u.pdf"), ("f", 1, "Credit Factors"), ("f", 2, "- [Red] Late"), ("f", 3, None), ("f", 4, "- [Green] Late")],
                               "file string, line_no int, text string")
    got = S.parse_expectations(df)
    assert [tuple(r) for r in got.collect()] == [("u.pdf", "Late", "green")]
    assert all("text#" not in part.split("\n")[0] for part in _plan(got).split("Window ")[1:])


def test_stretches_nobody_asks_for_are_not_shuffled(spark, monkeypatch):
    from creditloom.operators import matching

    seen = []
    monkeypatch.setattr(matching, "join_small", lambda big, small, on, how="left": seen.append((on, big.count())) or big.join(small, on, how))
    items = spark.createDataFrame([("a", 1, ["Oak"])], "r string, i int, t array<string>")
    found = spark.createDataFrame([("a", 3, "12 Oak st Aurora, co 80014"), ("b", 1, "9 Oak")], "r string, pos int, text string")
    got = matching.first_containing(items, found, ["r"], ["i"], "t", "pos", "text").collect()
    assert [tuple(r) for r in got] == [("a", 1, 3, "12 Oak st Aurora, co 80014")]
    assert [n for on, n in seen if "r" in on] == [2]


def test_phrases_are_taken_apart_once(spark, monkeypatch):
    from creditloom.operators import matching

    seen = []
    monkeypatch.setattr(matching, "join_small", lambda big, small, on, how="left": seen.append(small.count()) or big.join(small, on, how))
    asked = spark.createDataFrame([(f"r{i}", p) for i in range(5) for p in ("Rev Lates", "!")], "report_id string, phrase string").unionByName(
        spark.createDataFrame([("r1", None)], "report_id string, phrase string"))
    got = matching.phrase_colors(asked, lines(spark).withColumn("report_id", F.lit("r1"))).where("color is not null")
    assert [(r.report_id, r.phrase, r.color) for r in got.collect()] == [("r1", "Rev Lates", "red")] and seen == [3]


def test_merged_lines_alone_are_coloured_again(spark):
    """Colours taken over from unmerged lines are those of a fresh look at every line's spans."""
    shades = [[220, 53, 69], [66, 143, 78], [33, 37, 41], [0, 0, 0], None]
    texts = ["$5", "12 rev lates", "$1,000", "$7", "Over limit accts", "3 / $9"]
    rows = [(r, i // 4, i, texts[(i + r) % 6], [(texts[(i + r) % 6], shades[(i * 3 + r) % 5], [float(i % 4), 0.0, 9.0, 9.0])]) for r in range(5) for i in range(12)]
    df = spark.createDataFrame(rows, "report_id int, page int, pos int, text string, spans array<struct<text string, rgb array<int>, bbox array<double>>>")
    merged = R.L.merge_dollar_lines(R.colored(df))
    want = R.colored(merged.drop("color", "hex")).select("report_id", "pos", "text", "merged", "color", "hex").collect()
    got = R._recolored(merged).select("report_id", "pos", "text", "merged", "color", "hex").collect()
    assert sorted(got, key=str) == sorted(want, key=str) and {r.merged for r in got} == {True, False}


def test_report_rows_colour_lines_once(spark, monkeypatch):
    texts = [["Credit Score: 701", "Seasoned closed accounts", "Charged Off Accts", "2 / $1,200"], ["Age: 44", "No 5k+ lines"]]
    rows = [(r, i // 3, i, t, [0.0, 0.0, 9.0, 9.0], [(t, rgb, [x, 0.0, x + 5, 9.0])]) for r, ts in enumerate(texts) for i, t in enumerate(ts)
            for rgb, x in [([220, 53, 69] if i % 2 else [66, 143, 78], 300.0 * (i % 2))]]
    lines = spark.createDataFrame(rows, "report_id long, page int, pos long, text string, bbox array<double>, "
                                  "spans array<struct<text: string, rgb: array<int>, bbox: array<double>>>")
    factors = R.report_factors(lines)
    listed = {r.report_id: r for r in L.factor_arrays(factors, ["report_id"], ["prio", "factor"]).collect()}
    counts = {r.report_id: r for r in L.color_counts(factors, ["report_id"]).collect()}
    assert listed
    calls, plain = [], R.colored
    monkeypatch.setattr(R, "colored", lambda x: calls.append(1) or plain(x))
    got = {r.report_id: r for r in R.report_rows(lines).collect()}
    assert len(calls) == 1 and set(got) == {0, 1} and got[0].credit_score == 701 and got[1].age == 44
    for i, r in got.items():
        assert r.credit_factors == (listed[i].credit_factors if i in listed else [])
        for c in ("red", "green", "black"):
            assert r[f"{c}_credit_factors_count"] == (counts[i][f"{c}_credit_factors_count"] if i in counts else 0)
