"""The numbered queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.align import alignment_counts
from quotelake.llm.common import table
from quotelake.llm.forest import vector_duplicates
from quotelake.llm.langid import fit, identify, remainder
from quotelake.llm.lines import dedup_lines
from quotelake.llm.near_dup import near_duplicates
from quotelake.llm.packing import pack_documents
from quotelake.llm.pieces import piece_digests
from quotelake.llm.preference import following, format_preferences, preference_digests
from quotelake.llm.search import build_index, search_index
from quotelake.llm.secrets import find_secrets, span_digests
from quotelake.llm.tokenfile import read_token_files, write_token_files
from quotelake.llm.trie import conversation_trie, ordered_turns, rebuilt_turns
from quotelake.llm.warc import round_trip


def op1_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_secrets(table(spark, sf_dir, "documents")))


def op4_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search_index(docs.where(F.col("doc_id") % 100 == 0), build_index(docs), 10)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (remainder(F.col("doc_id")) == 2).alias("held_out")
    model = fit(docs.where(remainder(F.col("doc_id")) != 2))
    return identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(spark, table(spark, sf_dir, "pages"))
    return records.where("indexed").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), path, with_ids=False)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select(
        "doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"),
        F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen is every conversation with an answer; rejected has the last answer of the next such one instead,
    the last conversation that of the first."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "pair_id")
    last = (
        turns.where("role = 'assistant'").groupBy("pair_id")
        .agg(F.max("turn").alias("last"), F.max_by("text", F.struct("turn", "text")).alias("answer"))
    )
    other = following(last, "pair_id", "answer", "other")
    rejected = turns.join(other, "pair_id").withColumn(
        "text", F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.col("other"))
        .otherwise(F.col("text")),
    )
    return preference_digests(format_preferences(turns, rejected))


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations begin with up to eight turns of the one whose id is the multiple of five at or below theirs."""
    raw, conv = table(spark, sf_dir, "conversations"), F.col("conv_id")
    convs = raw.where("conv_id is not null").select("conv_id").distinct()
    shared, donor = F.crc32(conv.cast("string")) % 9, conv - conv % 5
    return conversation_trie(rebuilt_turns(convs, ordered_turns(raw), shared, donor, 8), convs)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment_counts(table(spark, sf_dir, "documents"), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_forest": op1_embedding_forest,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secret_scan": op3_secret_scan,
    "op4_block_max_search": op4_block_max_search,
    "op5_language_id": op5_language_id,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_vector_packing": op7_vector_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_preference_pairs": op9_preference_pairs,
    "op10_tensored_minhash": op10_tensored_minhash,
    "op11_token_files": op11_token_files,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE = {
    "op1_embedding_forest": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), n as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as size from v
  where vec_id is not null and label is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), links as (
  select a.vec_id as u, b.vec_id as v from n a join n b on a.label = b.label and a.vec_id <> b.vec_id
  where a.size > 0 and b.size > 0 and list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach(u, v) as (
  select vec_id, vec_id from embeddings union select r.u, l.v from reach r join links l on l.u = r.v
), least_of as (select u, min(v) as component_id from reach group by u),
counts as (select u, count(*) as n_links from links group by u)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join least_of l on l.u = vec_id left join counts c on c.u = vec_id
""",
    "op4_block_max_search": r"""
with words as (
  select doc_id, unnest(list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w
  from documents
), uses as (select doc_id, w, count(*) as c from words group by all),
sizes as (select doc_id, coalesce(sum(c), 0) as n from documents left join uses using (doc_id) group by doc_id),
whole as (select count(*) as docs, avg(n) as mean from sizes),
df as (select w, count(*) as df from uses group by w),
scored as (
  select q.doc_id as query_id, d.doc_id, round(sum(
    q.c * ln(1 + (docs - df + 0.5) / (df + 0.5)) * d.c * 2.2 / (d.c + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score
  from uses q join uses d using (w) join df using (w) join sizes s on s.doc_id = d.doc_id cross join whole
  where q.doc_id % 100 = 0 group by all
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored
)
select query_id, rank, doc_id, score from ranked where rank <= 10
""",
    "op9_preference_pairs": """
with last as (
  select conv_id, max(turn) as last, arg_max(text, turn) as answer from conversations where role = 'assistant' group by 1
), pairs as (
  select conv_id, last, case when conv_id = max(conv_id) over () then first_value(answer) over (order by conv_id)
    else lead(answer) over (order by conv_id) end as other from last
), turns as (
  select conv_id, turn, role, text, last, case when turn = last and role = 'assistant' then other else text end as alt
  from conversations join pairs using (conv_id)
), ends as (select conv_id, min(turn) filter (where text <> alt) as e from turns group by 1),
parts as (
  select conv_id, turn, role, text, 'prompt' as part from turns join ends using (conv_id) where e is null or turn < e
  union all select conv_id, turn, role, text, 'chosen' from turns join ends using (conv_id) where turn >= e
  union all select conv_id, turn, role, alt, 'rejected' from turns join ends using (conv_id) where turn >= e
), shown as (
  select conv_id, turn, part, role = 'assistant' and part <> 'prompt' as trained,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as t from parts
)
select conv_id as pair_id, count(*) filter (where part = 'prompt') as prompt_turns,
  coalesce(sum(length(t)) filter (where part = 'prompt'), 0)::bigint as prompt_chars,
  coalesce(sum(length(t)) filter (where part = 'chosen'), 0)::bigint as chosen_chars,
  coalesce(sum(length(t)) filter (where part = 'rejected'), 0)::bigint as rejected_chars,
  coalesce(sum(length(t)) filter (where part = 'chosen' and trained), 0)::bigint as chosen_trained_chars,
  coalesce(sum(length(t)) filter (where part = 'rejected' and trained), 0)::bigint as rejected_trained_chars,
  sum(('0x' || substr(md5(part || '|' || turn || '|' || t), 1, 8))::bigint)::bigint as digest
from shown group by conv_id
""",
    "op6_warc_round_trip": """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages
), first as (select h, max(page_id) as m from p group by h)
select page_id, octet_length(encode(body))::bigint as payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(p.h, 5 * i + 1, 5))::int >> s & 31) + 1, 1), '' order by i, s desc)
   from range(8) a(i), (values (15), (10), (5), (0)) b(s)) as payload_digest,
  case when page_id = m then 'response' else 'revisit' end as record_type,
  case when page_id <> m then m end as refers_to
from p join first using (h)
""",
    "op8_line_dedup": r"""
with parts as (
  select doc_id, text, string_split(text, chr(10)) as p from documents
), raw as (
  select doc_id, unnest(range(0, len(p))) as place, unnest(p) as full_line from parts
), lines as (
  select doc_id, place, trim(full_line, ' ') as line from raw where length(trim(full_line, ' ')) >= 20
), firsts as (
  select line, length(line) as n, min({'d': doc_id, 'p': place}) as first from lines group by line
), near as (
  select a.line, min(b.first) as other from firsts a join firsts b
  on b.n between a.n - 2 and a.n + 2 and b.first < a.first where levenshtein(a.line, b.line) <= 2 group by a.line
), cut as (
  select doc_id, place from lines join firsts using (line) left join near using (line)
  where first <> {'d': doc_id, 'p': place} or other is not null
), kept as (
  select r.doc_id, string_agg(full_line, chr(10) order by r.place) as t
  from raw r anti join cut c on c.doc_id = r.doc_id and c.place = r.place group by r.doc_id
), dropped as (
  select doc_id, count(*) as n, string_agg(place::varchar, ',' order by place) as l from cut group by doc_id
)
select doc_id, coalesce(n, 0)::bigint as n_dropped, coalesce(l, '') as dropped, sha256(coalesce(t, '')) as text_sha256
from documents left join kept using (doc_id) left join dropped using (doc_id)
""",
    "op10_tensored_minhash": r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
), links as (
  select u, v from pairs join sizes x on x.doc_id = u join sizes y on y.doc_id = v
  where 100 * c >= 75 * (x.n + y.n - c)
), reach(u, v) as (
  select doc_id, doc_id from documents union select r.u, l.v from reach r join links l on l.u = r.v
), least_of as (select u, min(v) as component_id from reach group by u)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from documents left join sizes using (doc_id) join least_of on u = doc_id
""",
    "op12_prefix_trie": """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null
), c as (
  select distinct conv_id, conv_id - conv_id % 5 as donor, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))
  )) % 9 as h from t
), parts as (
  select c.conv_id, 0 as part, pos, role, text from c join t on t.conv_id = donor and pos <= h
  union all select conv_id, 1, pos, role, text from c join t using (conv_id) where pos > h
), rebuilt as (
  select *, row_number() over (partition by conv_id order by part, pos) as d from parts
), paths as (
  select conv_id, d, octet_length(encode(text)) as bytes,
    string_agg(md5(role || chr(1) || text), '') over (partition by conv_id order by d) as k from rebuilt
  union all select conv_id, 0, 0, '' from c
), nodes as (
  select d, k, min(conv_id) as conv_id, count(*) as n, any_value(bytes) as bytes from paths group by d, k
), ended as (
  select k, string_agg(conv_id::varchar, ',' order by conv_id) as ids
  from (select conv_id, max_by(k, d) as k from paths group by conv_id) group by k
), children as (select substr(k, 1, 32 * (d - 1)) as k, count(*) as m from nodes where d > 0 group by 1),
below as (
  select a.k, sum((b.n - 1) * b.bytes) as saved, count(*) filter (where m is null) as leaves
  from nodes a join (select * from nodes left join children using (k)) b on substr(b.k, 1, 32 * a.d) = a.k group by a.k
)
select a.conv_id, a.d::bigint as depth, p.conv_id as parent_conv_id, a.n as n_convs, coalesce(m, 0)::bigint as n_children,
  leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from nodes a join below using (k) left join children using (k) left join ended using (k)
  left join nodes p on a.d > 0 and p.d = a.d - 1 and p.k = substr(a.k, 1, 32 * (a.d - 1))
""",
}
