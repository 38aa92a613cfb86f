"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.alignment import align
from creditloom.llm.archives import arc_to_warc, warc_captures, with_originals, write_arc
from creditloom.llm.chat import digests, format_conversations
from creditloom.llm.collocations import collocations
from creditloom.llm.decontaminate import overlaps
from creditloom.llm.files import run_folder
from creditloom.llm.language import identify
from creditloom.llm.mixing import mix
from creditloom.llm.quality import quality_scores
from creditloom.llm.simhash import near_duplicates
from creditloom.llm.substring_dedup import remove_repeats
from creditloom.llm.token_counts import token_counts
from creditloom.llm.token_files import read_tokens, with_starts, write_tokens
from creditloom.llm.winnowing import edit_likeness
from creditloom.operators.sizing import settle


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, s, array_to_string(w[s:s + 49], ' ') as t from w, unnest(range(1, len(w) - 48)) as u(s) where len(w) >= 50
), firsts as (
  select doc_id, s, min(doc_id) over (partition by t) as first from windows
), gone as (
  select distinct doc_id, s + k as p from firsts, range(50) as r(k) where first < doc_id
), kept as (
  select w.doc_id, p, w.w[p] as word from w, unnest(range(1, len(w.w) + 1)) as u(p)
  where not exists (select 1 from gone where gone.doc_id = w.doc_id and gone.p = u.p)
), joined as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from kept group by doc_id
)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join joined using (doc_id)
"""


def token_file_digests(docs: DataFrame, folder: str) -> DataFrame:
    """Write the documents' ids to ``folder`` and describe what reading them back gives."""
    write_tokens(docs, folder, tokenizer_path("word_bpe_49k.json"))
    got = settle(read_tokens(docs.sparkSession, folder).select(
        "part", "shard", "position", "doc_id", F.floor(F.length("tokens") / 4).alias("n_tokens"), F.crc32("tokens").alias("ids_crc32")))
    return with_starts(got).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(read(spark, sf_dir, "documents"), run_folder(spark, "tokens"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(read(spark, sf_dir, "documents"))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = run_folder(spark, "arc"), run_folder(spark, "warc")
    write_arc(read(spark, sf_dir, "pages"), arc)
    arc_to_warc(spark, arc, warc)
    return with_originals(warc_captures(spark, warc))


OP7_SQL = """
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first then first end as refers_to
from (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest,
             min(page_id) over (partition by coalesce(html, '')) as first from pages)
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    path = tokenizer_path("byte_bpe_50k.json")
    return digests(settle(format_conversations(turns, path)), path)


OP8_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown as (
  select *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') as r, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as t from turns
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<|turn|>') + length(r) + length('<|text|>') + length(t) + length('<|end|>'))::bigint as formatted_chars
from shown group by conv_id
"""


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
  from documents
), f as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f
  from pieces, unnest(range(1, len(w) + 1)) as u(i), (values (1), (2), (3)) as v(m) where i + m - 1 <= len(w) group by all
), sizes as (
  select lang, sum(f)::bigint as n from f where m = 1 group by lang
), candidates as (
  select *, string_split(phrase, ' ') as x from f where m > 1 and f >= 10
), covered as (
  select distinct c.lang, c.phrase from candidates c join (
    select lang, f, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) as phrase from candidates where m = 3) t
  on c.lang = t.lang and c.phrase = t.phrase and 100 * t.f >= 50 * c.f
), cuts as (
  select c.lang, c.phrase, c.f as a, k, array_to_string(x[1:k], ' ') as p, array_to_string(x[k + 1:m], ' ') as q
  from candidates c, (values (1), (2)) as v(k) where k < m and (c.lang, c.phrase) not in (select (lang, phrase) from covered)
), scored as (
  select cuts.lang, cuts.phrase, a, k, p.f as l, q.f as r, (1000000::hugeint * a * a) // (p.f::hugeint * q.f) as score
  from cuts join f p on p.lang = cuts.lang and p.phrase = cuts.p join f q on q.lang = cuts.lang and q.phrase = cuts.q
  qualify row_number() over (partition by cuts.lang, cuts.phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from scored join sizes using (lang) qualify rank <= 2000
"""

def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_substring_dedup": (op2_substring_dedup, OP2_SQL),
    "op3_token_files": (op3_token_files, None),
    "op4_simhash": (op4_simhash, None),
    "op5_decontamination": (op5_decontamination, None),
    "op6_winnowing": (op6_winnowing, None),
    "op7_arc_to_warc": (op7_arc_to_warc, OP7_SQL),
    "op8_chat_format": (op8_chat_format, OP8_SQL),
    "op9_source_mixing": (op9_source_mixing, None),
    "op10_language_id": (op10_language_id, None),
    "op11_collocations": (op11_collocations, OP11_SQL),
    "op12_token_alignment": (op12_token_alignment, None),
    "op13_quality": (op13_quality, None),
}
