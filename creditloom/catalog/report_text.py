"""Report-line queries. Lines come from lineitem (one report per order) and from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.tables import table
from creditloom.functions import color as K
from creditloom.functions import text as X
from creditloom.operators import lines as L
from creditloom.operators import matching as J
from creditloom.operators import report_diff as D
from creditloom.operators.scans import neighbours
from creditloom.plans import report_rows as R
from creditloom.sources import reports as S

ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
# Every line's text is picked by its part key; the numbers in it come from the row.
TEXT_CASES = [
    "'Credit Factors'", "'$' || l_suppkey", "'$' || l_suppkey || ',500'", "'Revolving Accounts'",
    "l_linenumber || ' / $' || l_partkey || ',881'", "'Public Records'", "'Bankruptcy CH-7  Discharged - 3/16/2021'",
    "l_suppkey", "'Inquires (Last 6 Months)'", "'2 Rev Lates in 0-3 mo'", "'No 5k+ lines'", "'Avg age open ' || l_suppkey",
    "'No'", "'Credit Freeze'", "'$' || l_partkey || '/mo'", "'Charged Off Accts'", "'Remarks'", "'Paid Off 200k+ RE/RE'",
    "'Seasoned closed accounts'", "'Unpaid collections'", "'Drop Bad Auth'", "(l_suppkey + 300)", "'Age: ' || l_suppkey",
    "'Light open rev depth'",
]
RGBS = ["220, 53, 69", "66, 143, 78", "33, 37, 41", "0, 0, 0", "232, 146, 62"]


def _text_sql(cast: str) -> str:
    arms = " ".join(f"when {i} then cast({t} as {cast})" for i, t in enumerate(TEXT_CASES))
    return f"case l_partkey % {len(TEXT_CASES)} {arms} end"


def _spark_text() -> str:
    return _text_sql("string")


LINES = f"""lines as (select l_orderkey report_id, row_number() over (partition by l_orderkey order by {ORDER}) - 1 as pos,
  (row_number() over (partition by l_orderkey order by {ORDER}) - 1) // 3 page, {_text_sql('varchar')} as text,
  l_suppkey % 5 c, l_quantity * 10 x0 from lineitem)"""


def report_lines(spark, sf):
    """report_id, page, pos, text, spans: a report's lines in order."""
    li = table(spark, sf, "lineitem")
    keys = [k.strip() for k in ORDER.split(",")]
    # The text goes through the grouping, or every use of it would pick and build it again. It follows
    # from the keys, so the order stays theirs; sort_array is compiled, unlike lambda-based sorts.
    items = li.select("l_orderkey", F.struct(*keys, F.expr(_spark_text()).alias("text")).alias("s")).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list("s")).alias("s"))
    rows = items.select(F.col("l_orderkey").alias("report_id"), F.posexplode("s").alias("pos", "s")).select("report_id", "pos", "s.*")
    rgb = F.get(F.array(*[F.array(*[F.lit(int(v)) for v in c.split(",")]) for c in RGBS]), (F.col("l_suppkey") % 5).cast("int"))
    text = F.col("text")
    box = F.array(*[F.col("l_quantity") * 10, F.lit(0.0), F.col("l_quantity") * 10 + 5, F.lit(9.0)])
    return rows.select("report_id", F.floor(F.col("pos") / 3).cast("int").alias("page"), F.col("pos").cast("bigint").alias("pos"),
                       text.alias("text"), F.array(F.struct(text.alias("text"), rgb.alias("rgb"), box.alias("bbox"))).alias("spans"))


def document_lines(spark, sf):
    """doc_id, line_no, text: whole documents cut at line breaks."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


DOC_LINES = """dl as (select doc_id, unnest(range(len(p))) line_no, unnest(p) as text from (select doc_id, string_split(text, chr(10)) p from documents))"""


def line_canonical(spark, sf):
    return report_lines(spark, sf).select("report_id", "pos", X.canonical_text(F.col("text")).alias("canon"),
                                          X.factor_key(F.col("text")).alias("key"))


CANON = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\$[0-9,]+', ' ', 'g'), '^\s*\d+\s+', ' '), '[^a-z0-9\s+\-]', ' ', 'g'), '\s+', ' ', 'g'))"""
_RULES = " ".join("when regexp_matches(canon, '{}') then '{}'".format(p, k) for p, k in X.FACTOR_RULES)
CANON_SQL = f"""with {LINES}, c as (select report_id, pos, {CANON} canon from lines)
select report_id, pos, canon, case {_RULES} else trim(regexp_replace(canon, '[^a-z0-9]+', '_', 'g'), '_') end as key from c"""


def document_canonical(spark, sf):
    d = document_lines(spark, sf).groupBy("doc_id").agg(
        F.sum(F.length(X.canonical_text(F.col("text")))).alias("chars"), F.count_if(X.table_like(F.col("text"))).alias("n_table"))
    return d


DOC_CANON_SQL = rf"""with {DOC_LINES}, t as (select *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') toks from dl)
select doc_id, cast(sum(length({CANON})) as bigint) chars, count(*) filter (regexp_matches(text, '^[$\d.,\s%\-]+$')
  or (len(list_filter(toks, lambda x: regexp_matches(x, '[\d$%]'))) >= 2 and len(list_filter(toks, lambda x: regexp_matches(x, '[\d$%]')))
   > len(list_filter(toks, lambda x: regexp_matches(x, '[A-Za-z]'))))) n_table from t group by 1"""


def pair_parse(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.expr("case l_linenumber % 6 when 0 then concat(cast(l_suppkey as string), ' / $', l_partkey) when 1 then concat('$', l_partkey, ' / ', l_suppkey) "
               "when 2 then concat('0 / $0, ', l_linenumber, '/', l_partkey + 1001) when 3 then concat('$', l_partkey, ' / mo') "
               "when 4 then concat(l_partkey + 1001, ' / ', l_suppkey) else 'n/a' end")
    p = X.count_amount_pair(s)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", p["count"].alias("count"), p["amount"].alias("amount"))


PAIR_SQL = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  case l_linenumber % 6 when 0 then case when l_suppkey = 0 and l_partkey = 0 then null else l_suppkey end
    when 1 then case when l_suppkey = 0 and l_partkey = 0 then null else l_suppkey end when 2 then l_linenumber when 4 then l_suppkey end as count,
  case l_linenumber % 6 when 0 then case when l_suppkey = 0 and l_partkey = 0 then null else l_partkey end
    when 1 then case when l_suppkey = 0 and l_partkey = 0 then null else l_partkey end when 2 then l_partkey + 1001 when 4 then l_partkey + 1001 end amount
from lineitem
"""


def colour_map(spark, sf):
    p = table(spark, sf, "part")
    names = list(K._TABLE)
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    raw = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("#"), F.upper(pick))).when(F.col("p_size") % 5 == 1, F.col("p_name")).otherwise(pick)
    packed = (F.col("p_partkey") * 7919 % 16777216).cast("int")
    rgb = K.packed_to_rgb(packed)
    return p.select("p_partkey", K.color_category(raw).alias("category"), K.rgb_to_hex(rgb).alias("hex"),
                    F.get(K.hex_to_rgb(K.rgb_to_hex(rgb)), 1).alias("green"))


_NAMES = list(K._TABLE)
COLOUR_SQL = "with n as (select * from (values " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(K._TABLE.items())) + f""") t(i, k, v))
select p_partkey, case when p_size % 5 = 1 then 'other' else v end category,
  '#' || lpad(lower(to_hex((p_partkey * 7919) % 16777216)), 6, '0') as hex, cast((((p_partkey * 7919) % 16777216) // 256) % 256 as int) green
from part join n on i = p_partkey % {len(_NAMES)}"""


def span_colors(spark, sf):
    s = R.colored(report_lines(spark, sf))
    return s.select("report_id", "pos", "color", "hex", F.get(K.span_box(F.col("spans")), 2).alias("x1"))


SPAN_SQL = f"""with {LINES} select report_id, pos, case c when 0 then 'red' when 1 then 'green' when 2 then 'black' when 3 then 'neutral' else 'amber' end color,
  case c when 0 then '#dc3545' when 1 then '#428f4e' when 4 then '#e8923e' when 2 then '#212529' end as hex, x0 + 5 x1 from lines"""


def next_line_value(spark, sf):
    v = neighbours(report_lines(spark, sf), ["report_id"], "pos", "text", before=1, after=2, chunk=4)
    return v.select("report_id", "pos", "prev_1", "next_1", "next_2")


NEXT_SQL = f"""with {LINES} select report_id, pos, lag(text) over w prev_1, lead(text) over w next_1, lead(text, 2) over w next_2 from lines
window w as (partition by report_id order by pos)"""


def section_slice(spark, sf):
    return L.section(report_lines(spark, sf)).select("report_id", "pos", "text")


ENDS = " or ".join(f"contains(lower(text), '{e}')" for e in L.SECTION_ENDS)
SECTION_SQL = f"""with {LINES}, a as (select report_id, min(pos) s from lines where starts_with(lower(trim(text)), 'credit factors') group by 1),
e as (select report_id, min(pos) e from lines join a using (report_id) where pos > s and ({ENDS}) group by 1)
select report_id, pos, text from lines join a using (report_id) left join e using (report_id) where pos > s and (e is null or pos < e)"""


def page_region(spark, sf):
    return L.region(report_lines(spark, sf), max_pages=1).select("report_id", "pos", "page")


MARKS = " or ".join(f"contains(lower(text), '{e}')" for e in L.REGION_ENDS)
REGION_SQL = f"""with {LINES}, a as (select report_id, coalesce(min(page) filter (contains(text, 'Credit Factors')), min(page)) s from lines group by 1),
i as (select lines.*, s from lines join a using (report_id) where page = s),
e as (select report_id, min(pos) e from i where {MARKS} group by 1)
select report_id, pos, page from i left join e using (report_id) where e is null or pos < e"""


def merge_pairs(spark, sf):
    return L.merge_dollar_lines(report_lines(spark, sf)).select("report_id", "pos", "text", "merged")


# The greedy left-to-right rule itself, row by row: "open" says whether the row before is still waiting.
MERGE_SQL = f"""with recursive {LINES}, d as (select *, regexp_full_match(text, '\\$[0-9,]+') dollar, pos - page * 3 i,
  lead(text) over (partition by report_id, page order by pos) nxt from lines),
g as (select report_id, page, i, dollar and nxt is not null as head, false as used from d where i = 0
  union all select d.report_id, d.page, d.i, d.dollar and d.nxt is not null and not g.head, g.head from d
    join g on d.report_id = g.report_id and d.page = g.page and d.i = g.i + 1)
select report_id, pos, case when head then text || ' ' || nxt else text end as text, head merged from d join g using (report_id, page, i) where not used"""


def take_pairs(spark, sf):
    return L.take_next_pair(report_lines(spark, sf)).select("report_id", "pos", "text", "count", "total")


TAKE_SQL = f"""with recursive {LINES}, n as (select *, case when regexp_matches(text, '^\\d+ / \\$') then try_cast(regexp_extract(text, '^(\\d+)', 1) as bigint)
     when contains(text, '3/16') then 3 end pc, case when regexp_matches(text, '^\\d+ / \\$') then try_cast(replace(regexp_extract(text, '\\$([0-9,]+)', 1), ',', '') as bigint)
     when contains(text, '3/16') then 16 end pa, regexp_full_match(text, '\\$?[0-9,]+') skip from lines),
d as (select *, pc is not null is_pair, lead(pc) over w nc, lead(pa) over w na from n window w as (partition by report_id order by pos)),
g as (select report_id, pos, false used, not skip emits from d where pos = 0
  union all select d.report_id, d.pos, g.emits and d.is_pair, not d.skip and not (g.emits and d.is_pair) from d
    join g on d.report_id = g.report_id and d.pos = g.pos + 1)
select report_id, pos, text, nc as count, na total from d join g using (report_id, pos) where emits"""


def severity_dedupe(spark, sf):
    src = R.colored(report_lines(spark, sf)).select("report_id", "pos", "text", "color")
    return L.dedupe_by_severity(src, ["report_id"], X.factor_key(F.col("text"))).select("report_id", "canonical", "pos", "text", "color")


DEDUPE_SQL = f"""with {LINES}, c as (select *, {CANON} canon, case c when 0 then 5 when 4 then 4 when 1 then 3 when 2 then 2 else 1 end prio from lines),
k as (select *, case {_RULES} else trim(regexp_replace(canon, '[^a-z0-9]+', '_', 'g'), '_') end canonical from c),
r as (select *, row_number() over (partition by report_id, canonical order by prio desc, pos) rn, min(pos) over (partition by report_id, canonical) first_pos from k)
select report_id, canonical, first_pos pos, text, case c when 0 then 'red' when 1 then 'green' when 2 then 'black' when 3 then 'neutral' else 'amber' end color
from r where rn = 1 and canonical not in ('payment_resp', 'past_due')"""


def factor_counts(spark, sf):
    return L.color_counts(R.colored(report_lines(spark, sf)), ["report_id"])


COUNTS_SQL = f"""with {LINES} select report_id, count(*) filter (c = 0) red_credit_factors_count, count(*) filter (c = 1) green_credit_factors_count,
  count(*) filter (c = 2) black_credit_factors_count from lines group by 1"""


def right_column(spark, sf):
    return L.right_column(report_lines(spark, sf)).select("report_id", "pos")


RIGHT_SQL = f"""with {LINES}, p as (select report_id, page, (min(x0) + max(x0)) / 2 mid from lines group by 1, 2)
select report_id, pos from lines join p using (report_id, page) where x0 > mid + 8 or (length(text) < 40 and x0 > mid - 40)"""


def table_rejects(spark, sf):
    return L.rejected_groups(report_lines(spark, sf), ["report_id"])


REJECT_SQL = rf"""with {LINES}, t as (select *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') toks from lines),
f as (select report_id, len(toks) n_tok, regexp_matches(text, '^[$\d.,\s%\-]+$') or (len(list_filter(toks, lambda x: regexp_matches(x, '[\d$%]'))) >= 2
  and len(list_filter(toks, lambda x: regexp_matches(x, '[\d$%]'))) > len(list_filter(toks, lambda x: regexp_matches(x, '[A-Za-z]')))) tab from t)
select report_id from f group by 1 having count(*) > 30 or count(*) filter (tab) / count(*) >= 0.4
  or (count(*) >= 3 and count(*) filter (n_tok = 1) / count(*) >= 0.4)"""


def trivial_lines(spark, sf):
    src = R.colored(report_lines(spark, sf))
    return src.where(X.trivial_factor(F.col("text"), F.col("color"))).groupBy("text").agg(F.count("*").alias("n_lines"))


_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
TRIVIAL_SQL = rf"""with {LINES}, t as (select *, trim(text) t, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) n from lines)
select text, count(*) n_lines from t where
  (n < 2 and not regexp_matches(t, '\d') and c = 3 and not regexp_matches(t, '(?i)charged off|unpaid collection|over limit|closed|seasoned'))
  or lower(t) in ({_LIST(X.HEADER_WORDS)})
  or (regexp_matches(t, '^\s*\$[\d,]+(?:\s+[A-Z0-9/()\-]+)+\s*$') and not regexp_matches(t, '[a-z]'))
  or regexp_matches(t, '(?i)^\s*\$[\d,]+\s+(Account|Balance)\s*$')
  or (contains(t, '/') and not regexp_matches(t, '(?i)rev|late|charged|collection|account|credit'))
  or (t = upper(t) and n <= 5 and not regexp_matches(t, '\d') and length(t) > 2)
  or (n = 1 and lower(t) in ({_LIST(X.TRIVIAL_WORDS)})) group by text"""


def phrase_lines(spark, sf):
    src = report_lines(spark, sf)
    return src.where(X.contains_any(F.col("text"), X.FACTOR_PHRASES)).select("report_id", "pos")


PHRASE_SQL = f"with {LINES} select report_id, pos from lines where " + " or ".join(f"contains(lower(text), '{p}')" for p in X.FACTOR_PHRASES)


def colour_overrides(spark, sf):
    src = R.colored(report_lines(spark, sf))
    return src.select("report_id", "pos", K.override_color(F.col("text"), F.col("color")).alias("color"))


_OVER = " ".join(f"when contains(lower(text), '{f}') then '{c}'" for f, c in reversed(K.COLOR_OVERRIDES))
OVERRIDE_SQL = rf"""with {LINES} select report_id, pos, case when regexp_matches(lower(text), '\b(rev lates|rev late)\b') and regexp_matches(text, '\d') then 'red' {_OVER}
  else case c when 0 then 'red' when 1 then 'green' when 2 then 'black' when 3 then 'neutral' else 'amber' end end color from lines"""


def phrase_match(spark, sf):
    lines = document_lines(spark, sf)
    return J.phrase_candidates(table(spark, sf, "benchmark"), lines, "item_id", "text", ["doc_id", "line_no"], "text").select(
        "item_id", "doc_id", "line_no", "overlap", F.round("share", 6).alias("share"))


_TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
PHRASE_MATCH_SQL = rf"""with {DOC_LINES}, l as (select doc_id, line_no, list_distinct({_TOK.format('text')}) lt from dl),
p as (select item_id, list_filter(t, lambda x: length(x) > 2 or regexp_full_match(x, '\d+')) u, list_filter(t, lambda x: regexp_full_match(x, '\d+')) nums
  from (select item_id, {_TOK.format('text')} t from benchmark)),
c as (select item_id, doc_id, line_no, len(list_intersect(list_distinct(u), lt)) overlap, len(u) n,
  len(nums) = 0 or len(list_intersect(nums, lt)) > 0 ok from p, l where len(u) > 0)
select item_id, doc_id, cast(line_no as int) line_no, cast(overlap as int) overlap, round(overlap / n, 6) share from c where ok and overlap >= greatest(1, cast(floor(n * 0.5) as int))"""


def best_phrase_line(spark, sf):
    lines = document_lines(spark, sf).withColumns({
        "color": F.when(F.col("line_no") % 3 == 0, "red").otherwise("neutral"), "hex": F.lit(None).cast("string")})
    found = J.phrase_candidates(table(spark, sf, "benchmark"), lines, "item_id", "text", ["doc_id", "line_no"], "text")
    best = J.best_match(J.scored_candidates(found, lines, ["doc_id", "line_no"]), "item_id", ["doc_id", "line_no"])
    return best.select("item_id", "doc_id", "line_no", F.round("score", 6).alias("score"))


BEST_PHRASE_SQL = PHRASE_MATCH_SQL.replace("with ", "with x as (with ", 1) + rf"""), s as (select x.*, share + case when regexp_matches(lower(text), 'balanc') then 0.15 else 0 end
 - case when regexp_matches(lower(text), 'charg|chrg') then 0.20 else 0 end + case when line_no % 3 = 0 then 0.25 else 0 end score
 from x join (select doc_id, cast(unnest(range(len(p))) as int) line_no, unnest(p) as text from (select doc_id, string_split(text, chr(10)) p from documents)) using (doc_id, line_no))
select item_id, doc_id, line_no, round(score, 6) score from (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id, line_no) r from s) where r = 1"""


def factor_match(spark, sf):
    src = R.colored(report_lines(spark, sf))
    factors = src.where("pos % 2 = 1").select("report_id", "pos", F.when(F.col("pos") % 4 == 1, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("factor"))
    return J.match_factors(factors, src).select("report_id", "pos", "factor", "line_pos", "line_color", "match_type")


FACTOR_MATCH_SQL = f"""with {LINES}, f as (select report_id, pos, case when pos % 4 = 1 then text else text || '!' end factor from lines where pos % 2 = 1),
m as (select report_id, trim(text) k, min(pos) line_pos, arg_min(c, pos) c from lines group by 1, 2)
select f.report_id, f.pos, factor, line_pos, case c when 0 then 'red' when 1 then 'green' when 2 then 'black' when 3 then 'neutral' when 4 then 'amber' end line_color,
  case when line_pos is null then 'none' else 'exact' end match_type from f left join m on m.report_id = f.report_id and k = trim(factor)"""


def phrase_colours(spark, sf):
    """Lines of two spans each, cut in the middle, with colours of their own."""
    src = report_lines(spark, sf).withColumn("_n", F.floor(F.length("text") / 2).cast("int"))
    key = F.col("report_id") * 7 + F.col("pos") * 3
    rgb = lambda k: F.get(F.array(*[F.array(*[F.lit(int(v)) for v in c.split(",")]) for c in RGBS]), F.pmod(k, F.lit(5)).cast("int"))
    box = F.col("spans")[0]["bbox"].alias("bbox")
    spans = F.array(F.struct(F.expr("substring(text, 1, _n)").alias("text"), rgb(key).alias("rgb"), box),
                    F.struct(F.expr("substring(text, _n + 1)").alias("text"), rgb(key + F.col("pos")).alias("rgb"), box))
    src = src.withColumn("spans", spans).drop("_n")
    asked = ["charged off", "rev lates in 0-3", "Credit Freeze", "9 rev lates in 0-3 mo", "open age", "Accts charged", "lates in", "Remarks!"]
    phrases = src.select("report_id").distinct().select("report_id", F.explode(F.array(*[F.lit(p) for p in asked])).alias("phrase"))
    phrases = phrases.withColumn("expected", F.when((F.col("phrase") == "lates in") & (F.col("report_id") % 2 == 0), "red"))
    out = J.phrase_colors(phrases, src).where(F.col("pos").isNotNull())
    return out.select("report_id", "phrase", "page", "pos", "color", "uncertain")


# Written from the rule itself. Colours by number: 0 red, 1 green, 2 a dark grey that counts as
# black, 3 pure black (no colour), 4 amber; two different ones of red, green, amber mix to none.
PHRASE_COLOUR_SQL = f"""with {LINES}, q as (
  select * from (values ('charged off', ['charged', 'off'], []), ('rev lates in 0-3', ['rev', 'lates', '0', '3'], ['0', '3']),
    ('Credit Freeze', ['credit', 'freeze'], []), ('9 rev lates in 0-3 mo', ['9', 'rev', 'lates', '0', '3'], ['9', '0', '3']),
    ('open age', ['open', 'age'], []), ('Accts charged', ['accts', 'charged'], []), ('lates in', ['lates'], []), ('Remarks!', ['remarks'], [])) t(phrase, u, nums)),
l as (select *, length(text) // 2 n1, (report_id * 7 + pos * 3) % 5 a, (report_id * 7 + pos * 4) % 5 b,
  list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '') lt from lines),
m as (select l.*, q.*, case when phrase = 'lates in' and report_id % 2 = 0 then 'red' end wanted, strpos(lower(text), lower(phrase)) - 1 st,
  trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) = trim(regexp_replace(lower(phrase), '[^a-z0-9 ]', '', 'g')) same,
  list_intersect(list_distinct(u), lt) hit, len(u) n from l, q),
c as (select *, case when n1 > 0 then a else 3 end wa, b wb,
  case when st >= 0 and st < n1 then a else 3 end pa, case when st >= 0 and st + length(phrase) > n1 then b else 3 end pb from m),
k as (select *, case when wa in (0, 1, 4) and wb in (0, 1, 4) then case when wa = wb then wa else 9 end when wa in (0, 1, 4) then wa when wb in (0, 1, 4) then wb
    when wa = 2 or wb = 2 then 2 else 9 end wc,
  case when pa in (0, 1, 4) and pb in (0, 1, 4) then case when pa = pb then pa else 9 end when pa in (0, 1, 4) then pa when pb in (0, 1, 4) then pb
    when pa = 2 or pb = 2 then 2 else 9 end pc from c),
t as (select *, case pc when 0 then 'red' when 1 then 'green' when 2 then 'black' when 4 then 'amber' else 'neutral' end pcol,
  case wc when 0 then 'red' when 1 then 'green' when 2 then 'black' when 4 then 'amber' else 'neutral' end wcol from k),
e as (select *, (st >= 0 and pcol <> 'neutral' and (wanted is null or pcol = wanted)) cov from t),
f as (select *, (cov or same) ex, case when cov then pcol else wcol end color from e),
g as (select *, min(case when ex then page end) over (partition by report_id, phrase) fp from f),
r as (select *, case when ex then 1 else 2 end kind,
   case when ex then case color when 'green' then 1.0 when 'red' then 2.0 when 'amber' then 3.0 else 9.0 end
     else -(len(hit) / n - case when contains(lower(text), 'charg') then 0.2 else 0 end) end rk from g
   where color <> 'neutral' and (wanted is null or color = wanted)
     and (ex or ((fp is null or page < fp) and len(hit) >= greatest(1, n // 2) and len(hit) / n >= 0.33
       and (len(nums) = 0 or len(list_intersect(nums, lt)) > 0) and len(list_filter(hit, lambda x: regexp_full_match(x, '[a-z]+') and length(x) > 2)) > 0)))
select report_id, phrase, page, pos, color, kind = 2 uncertain
from (select *, row_number() over (partition by report_id, phrase order by page, kind, rk, pos) rn from r) where rn = 1"""


def asof_pair(spark, sf):
    e = table(spark, sf, "events").withColumns({
        "is_left": F.col("event_type") == "signup", "is_right": F.col("event_type") == "purchase",
        "day": F.to_date("ts"), "when": F.struct("ts", "event_id")})
    e = e.where("is_left or is_right").select("user_id", "event_id", "when", "day", "is_left", "is_right")
    return J.pair_in_order(e, ["user_id"], "day", ["when"], "is_left", "is_right").select("user_id", "event_id", "right_event_id")


# The greedy rule by its closed form; tests check that form against a step-by-step loop.
ASOF_SQL = """
with e as (select *, event_type = 'signup' l, event_type = 'purchase' r from events where event_type in ('signup', 'purchase')),
s as (select *, sum(l::int) over w t, sum(r::int) over w f from e window w as (partition by user_id order by ts, event_id)),
x as (select *, max(case when l then f + 1 - t end) over (partition by user_id order by ts, event_id) ee from s)
select a.user_id, a.event_id, b.event_id right_event_id from x a left join s b on b.user_id = a.user_id and b.r and b.f = a.t + a.ee where a.l
"""


def _altered(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("hits_count"))
    b = d.where("doc_id % 11 <> 0").withColumns({
        "source": F.when(F.col("doc_id") % 7 == 0, "moved").otherwise(F.col("source")),
        "hits_count": F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("hits_count"))})
    return d.where("doc_id % 13 <> 0"), b


def report_diff(spark, sf):
    a, b = _altered(spark, sf)
    return D.field_mismatches(a, b, ["doc_id"], ["lang", "source", "hits_count"])


DIFF_SQL = """
with d as (select doc_id, lang, source, n_chars hits_count from documents), a as (select * from d where doc_id % 13 <> 0),
b as (select doc_id, lang, case when doc_id % 7 = 0 then 'moved' else source end source, case when doc_id % 5 = 0 then null else hits_count end hits_count from d where doc_id % 11 <> 0),
u as (select doc_id, 'lang' field, lang v from a union all select doc_id, 'source', source from a union all select doc_id, 'hits_count', cast(hits_count as varchar) from a),
w as (select doc_id, 'lang' field, lang v from b union all select doc_id, 'source', source from b union all select doc_id, 'hits_count', cast(hits_count as varchar) from b),
j as (select coalesce(u.doc_id, w.doc_id) doc_id, coalesce(u.field, w.field) field,
  case when coalesce(u.field, w.field) = 'hits_count' then coalesce(u.v, '0') else u.v end value_a,
  case when coalesce(u.field, w.field) = 'hits_count' then coalesce(w.v, '0') else w.v end value_b,
  case when w.doc_id is null then 'only_a' when u.doc_id is null then 'only_b' else 'both' end side from u full join w on u.doc_id = w.doc_id and u.field = w.field)
select * from j where side <> 'both' or value_a is distinct from value_b
"""


def factor_multiset_diff(spark, sf):
    a = D.normalized_factors(document_lines(spark, sf).withColumn("color", F.lit("red")), ["doc_id"], "text")
    b = D.normalized_factors(document_lines(spark, sf).where("line_no % 9 <> 0").withColumn("color", F.lit("red")), ["doc_id"], "text")
    return D.multiset_diff(a, b, ["doc_id", "color", "text"]).select("doc_id", F.md5("text").alias("text"), "surplus")


MULTISET_SQL = f"""with {DOC_LINES}, n as (select doc_id, line_no, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') t from dl)
select doc_id, md5(t) as text, count(*) filter (line_no % 9 = 0) surplus from n group by doc_id, t having surplus > 0"""


def set_diff(spark, sf):
    words = lambda k: F.filter(F.array_distinct(X.word_tokens(F.col("text"))), lambda t: F.length(t) != k)
    d = table(spark, sf, "documents")
    out = D.set_diff(d.select("doc_id", words(3).alias("w")), d.where("doc_id % 2 = 0").select("doc_id", words(4).alias("w")), "doc_id", "w")
    return out.select("doc_id", F.size("only_a").alias("n_a"), F.size("only_b").alias("n_b"))


SET_SQL = rf"""with w as (select doc_id, list_distinct({_TOK.format('text')}) t from documents)
select doc_id, cast(case when doc_id % 2 = 0 then len(list_filter(t, lambda x: length(x) = 4)) else len(list_filter(t, lambda x: length(x) <> 3)) end as int) n_a,
  cast(case when doc_id % 2 = 0 then len(list_filter(t, lambda x: length(x) = 3)) else 0 end as int) n_b from w where n_a > 0 or n_b > 0"""


def missing_factors(spark, sf):
    o = table(spark, sf, "orders")
    return D.missing_keys(o.where("o_orderpriority = '1-URGENT'"), o, ["o_custkey"]).select("o_orderkey", "o_custkey")


def report_fields(spark, sf):
    f = R.report_fields(report_lines(spark, sf))
    return f.select("report_id", "monthly_payments", "credit_score", "age", "public_records", F.col("public_records_details.detail").alias("detail"),
                    F.col("public_records_details.date").alias("date"), "inquiries_last_6_months", "credit_freeze",
                    "revolving_open_count", "revolving_open_total")


FIELDS_SQL = rf"""with {LINES}, v as (select *, lag(text) over w p, lead(text) over w n from lines window w as (partition by report_id order by pos))
select report_id,
  arg_max(try_cast(regexp_replace(text, '[^0-9]', '', 'g') as bigint), pos) filter (regexp_matches(text, '^\$[0-9,]+/mo')) monthly_payments,
  arg_min(try_cast(text as int), pos) filter (regexp_full_match(text, '\d{{3,4}}')) credit_score,
  arg_max(try_cast(regexp_extract(text, '(?i)age[:\s]*([0-9]{{1,3}})', 1) as int), pos) filter (regexp_matches(text, '(?i)age[:\s]*[0-9]{{1,3}}')) age,
  cast(arg_max(case when regexp_full_match(n, '\d+') then try_cast(n as int) else 1 end, pos) filter (contains(lower(text), 'public records') and n is not null) as int) public_records,
  arg_max(trim(regexp_replace(regexp_replace(regexp_replace(n, '[-–—]\s*\d{{1,2}}/\d{{1,2}}/\d{{4}}$', ''), '\s+', ' ', 'g'), '(?i)CH-7\s+Discharged', 'CH-7Discharged')), pos)
    filter (contains(lower(text), 'public records') and n is not null and not regexp_full_match(n, '\d+')) detail,
  arg_max(struct_pack(d := case when contains(n, '3/16/2021') then '2021-03-16' end), pos) filter (contains(lower(text), 'public records') and n is not null and not regexp_full_match(n, '\d+')).d date,
  coalesce(arg_max(try_cast(regexp_extract(n, '(\d+)', 1) as int), pos) filter (contains(lower(text), 'inquires (last 6 months)') and regexp_matches(n, '\d')), 0) inquiries_last_6_months,
  coalesce(arg_max(case when lower(text) = 'yes' then 1 else 0 end, pos) filter (lower(text) in ('yes', 'no') and contains(lower(p), 'credit freeze')), 0) credit_freeze,
  arg_max(try_cast(regexp_extract(text, '^(\d+) / \$', 1) as int), pos) filter (regexp_matches(text, '^\d+ / \$') and contains(lower(p), 'revolving')) revolving_open_count,
  arg_max(try_cast(replace(regexp_extract(text, '^\d+ / \$([0-9,]+)', 1), ',', '') as bigint), pos) filter (regexp_matches(text, '^\d+ / \$') and contains(lower(p), 'revolving')) revolving_open_total
from v group by 1"""


# Lines of orders with streets and cities among them: number and name of a street come from the row.
STREETS = ["'Oak st'", "'Elm ave'", "'Pine rd'", "'Oakland dr'"]
ADDRESS_CASES = ["'Age: ' || l_suppkey", "(l_suppkey % 7) || ' ' || {s}", "'Aurora, co 80014'", "'since ' || (l_partkey % 40) || ' ' || {s} || ' Lyons, co 80540'",
                 "'No'", "(l_suppkey % 7) || ' / $5'", "'Remarks'", "'Remarks'"]


def _address_sql(cast: str) -> str:
    street = "case l_quantity % 4 " + " ".join(f"when {i} then {s}" for i, s in enumerate(STREETS)) + " end"
    arms = " ".join(f"when {i} then cast({t.format(s=street)} as {cast})" for i, t in enumerate(ADDRESS_CASES))
    return f"case l_partkey % {len(ADDRESS_CASES)} {arms} end"


def address_completion(spark, sf):
    """Streets of a customer's whole history, so that reports are long, and the lines that complete them."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("report_id")), "l_orderkey")
    keys = ["l_orderkey", *[k.strip() for k in ORDER.split(",")]]
    text = F.expr(_address_sql("string"))
    items = li.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct(*keys, text.alias("text")))).alias("s"))
    rows = items.select("report_id", F.posexplode("s").alias("pos", "s")).select("report_id", F.col("pos").cast("bigint").alias("pos"), "s.text")
    return R.street_cities(rows).select("report_id", "street", "pos", "city")


ADDRESS_SQL = rf"""with li as (select o_custkey report_id, row_number() over (partition by o_custkey order by l_orderkey, {ORDER}) - 1 as pos,
  {_address_sql('varchar')} as text from lineitem join orders on o_orderkey = l_orderkey),
near as (select *, coalesce(lower(lag(text, 1) over w) like 'age%', false) or coalesce(lower(lag(text, 2) over w) like 'age%', false)
  or coalesce(lower(lag(text, 3) over w) like 'age%', false) or coalesce(lower(lag(text, 4) over w) like 'age%', false) as below
  from li window w as (partition by report_id order by pos)),
streets as (select distinct report_id, text street from near where (below and regexp_matches(text, '^\d+\s+'))
  or (regexp_matches(text, '^\d+\s+[A-Za-z]') and regexp_matches(text, '(?i)\b(st|ave|rd|dr)\b') and not regexp_matches(text, '[/$%]')))
select s.report_id, street, min(pos) as pos, arg_min(text, pos) as city from streets s join li on s.report_id = li.report_id
  and contains(text, split_part(street, ' ', 1)) and contains(text, split_part(street, ' ', 2)) and regexp_matches(text, '[A-Za-z][A-Za-z]\.?\s*\d{{5}}')
group by 1, 2"""


def report_factor_rows(spark, sf):
    return R.report_factors(report_lines(spark, sf)).select("report_id", "factor", "color", "key")


def report_row_table(spark, sf):
    r = R.report_rows(report_lines(spark, sf))
    return r.select("report_id", "credit_score", "red_credit_factors_count", "green_credit_factors_count", "black_credit_factors_count",
                    F.size("credit_factors").alias("n_factors"), F.size("address").alias("n_addresses"))


def public_record_notes(spark, sf):
    full = report_lines(spark, sf).groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("t"))
    p = X.public_records(F.col("t"))
    return full.select("report_id", p["count"].alias("count"), p["note"].alias("note"))


NOTES_SQL = rf"""with {LINES}, f as (select report_id, string_agg(text, chr(10) order by pos) t from lines group by 1),
e as (select report_id, coalesce(try_cast(nullif(regexp_extract(t, '(?i)Public\s+Records\s*[:\s]*([0-9]+)', 1), '') as int), 0) n,
  trim(regexp_extract(t, '(?i)((?:bankrupt(?:cy)?|bk\b|ch-\d+|chapter\s*\d+)[^\n]*)', 1)) note from f)
select report_id, case when n = 0 and note <> '' then 1 else n end as count, note from e"""


def check_rates(spark, sf):
    c = R.colored(report_lines(spark, sf)).select(F.col("report_id").cast("string").alias("pdf"), F.concat("text", F.lit("@"), "pos").alias("phrase"), F.struct(
        "color", "text", "hex", "page", F.lit(True).alias("found"), F.lit("red").alias("expected"), (F.col("color") == "red").alias("match")).alias("v"))
    log = c.groupBy("pdf").agg(F.map_from_entries(F.collect_list(F.struct("phrase", "v"))).alias("phrases")).withColumn("timestamp", F.lit("t"))
    checks = S.explode_checks(log)
    return S.match_rates(checks.withColumn("page_group", F.col("page")), ["page_group"]).withColumn("match_rate", F.round("match_rate", 6))


CHECK_SQL = f"with {LINES} select page page_group, count(*) n_phrases, count(*) n_found, count(*) filter (c = 0) n_match, round(avg((c = 0)::int), 6) match_rate from lines group by 1"


def expectation_texts(spark, sf):
    src = report_lines(spark, sf)
    text = F.when(F.col("pos") == 0, F.concat(F.lit("PDF file: data/user_"), "report_id", F.lit(".pdf"))).when(
        F.col("pos") == 1, "Credit Factors").when(F.col("pos") == 4, "").otherwise(F.concat(F.lit("- [Red] "), "text"))
    rows = src.select(F.col("report_id").cast("string").alias("file"), F.col("pos").alias("line_no"), text.alias("text"))
    return S.parse_expectations(rows)


EXPECT_SQL = f"with {LINES} select distinct 'user_' || report_id || '.pdf' as document, trim(text) phrase, 'red' color from lines where pos in (2, 3)"


def report_aliases(spark, sf):
    d = table(spark, sf, "documents")
    text = F.expr("""case doc_id % 4 when 0 then 'null'
      when 1 then concat('{"rec":{"pdf_file":"a/b/', doc_id, '.pdf","credit_score":{"value":', 300 + doc_id % 500, ',"color":"red"},"revolving_accounts_open":{"count":2,"amount":', n_chars, '},"inquiries_6mo":3}}')
      when 2 then concat('{"filename":"', doc_id, '.pdf","credit_score":', 300 + doc_id % 500, ',"address":"1 A St,, X, 12345","public_records_details":{"detail":"d","date": 2016-10-11},"late_pays":{"last_2_years":1,"last_over_2_years":2}}')
      else concat('{"filename":"', doc_id, '.pdf","revolving_open_count":5,"collections":{"open":1,"closed":4},"credit_factors":[{"factor":"x","color":"red"},{"factor":"y","color":"green"}],"credit_card_open_totals_no_retail":{"utilization_percent":40,"payment":7}}') end""")
    got = S.normalize_aliases(S.parse_report_text(d.withColumn("t", text), "t", "doc_id"))
    return got.select("report_id", "filename", "credit_score", "credit_score_color", "revolving_open_count", "revolving_open_total", "inquiries_last_6_months",
                      F.get("address", 0).alias("address"), F.col("public_records_details.date").alias("date"), "late_pays_gt2yr", "collections_closed",
                      "red_credit_factors_count", F.col("credit_card_open_totals.Percent").alias("pct"), F.col("credit_card_open_totals.Payment").alias("pay"))


ALIAS_SQL = """select doc_id report_id, doc_id || '.pdf' filename, case when doc_id % 4 in (1, 2) then 300 + doc_id % 500 end credit_score, case when doc_id % 4 = 1 then 'red' end credit_score_color,
  case doc_id % 4 when 1 then 2 when 3 then 5 end revolving_open_count, case when doc_id % 4 = 1 then n_chars end revolving_open_total, case when doc_id % 4 = 1 then 3 end inquiries_last_6_months,
  case when doc_id % 4 = 2 then '1 A St, X 12345' end address, case when doc_id % 4 = 2 then '2016-10-11' end date, case when doc_id % 4 = 2 then 2 end late_pays_gt2yr,
  case when doc_id % 4 = 3 then 4 end collections_closed, case when doc_id % 4 = 3 then 1 end red_credit_factors_count, case when doc_id % 4 = 3 then 40 end pct, case when doc_id % 4 = 3 then 7 end pay
from documents where doc_id % 4 <> 0"""

QUERIES = {
    "line_canonical": (line_canonical, CANON_SQL),
    "document_canonical": (document_canonical, DOC_CANON_SQL),
    "pair_parse": (pair_parse, PAIR_SQL),
    "colour_map": (colour_map, COLOUR_SQL),
    "span_colors": (span_colors, SPAN_SQL),
    "next_line_value": (next_line_value, NEXT_SQL),
    "section_slice": (section_slice, SECTION_SQL),
    "page_region": (page_region, REGION_SQL),
    "merge_pairs": (merge_pairs, MERGE_SQL),
    "take_pairs": (take_pairs, TAKE_SQL),
    "severity_dedupe": (severity_dedupe, DEDUPE_SQL),
    "factor_counts": (factor_counts, COUNTS_SQL),
    "right_column": (right_column, RIGHT_SQL),
    "table_rejects": (table_rejects, REJECT_SQL),
    "trivial_lines": (trivial_lines, TRIVIAL_SQL),
    "phrase_lines": (phrase_lines, PHRASE_SQL),
    "colour_overrides": (colour_overrides, OVERRIDE_SQL),
    "phrase_match": (phrase_match, PHRASE_MATCH_SQL),
    "best_phrase_line": (best_phrase_line, BEST_PHRASE_SQL),
    "factor_match": (factor_match, FACTOR_MATCH_SQL),
    "phrase_colours": (phrase_colours, PHRASE_COLOUR_SQL),
    "asof_pair": (asof_pair, ASOF_SQL),
    "report_diff": (report_diff, DIFF_SQL),
    "factor_multiset_diff": (factor_multiset_diff, MULTISET_SQL),
    "set_diff": (set_diff, SET_SQL),
    "missing_factors": (missing_factors, "select o_orderkey, o_custkey from orders where o_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')"),
    "report_fields": (report_fields, FIELDS_SQL),
    "address_completion": (address_completion, ADDRESS_SQL),
    "report_factor_rows": (report_factor_rows, None),
    "report_rows": (report_row_table, None),
    "public_record_notes": (public_record_notes, NOTES_SQL),
    "check_rates": (check_rates, CHECK_SQL),
    "expectation_texts": (expectation_texts, EXPECT_SQL),
    "report_aliases": (report_aliases, ALIAS_SQL),
}
