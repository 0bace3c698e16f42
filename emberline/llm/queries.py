"""The registered queries of the corpus operators and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard, line_dedup, mixing, pii, quality, repair, suffix_dedup, topk, url_filter, warc, whitening
from . import twins
from ._common import new_path, read

#: Target weights of the production mix; sources without one weigh 1.
MIX = mixing.MixParams(weights={"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5})


def bpe_params() -> bpe.BpeParams:
    import public_tokenizers

    return bpe.BpeParams(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), MIX)
    return mixed.select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), *mixing.ADDED)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = topk.TopKParams()
    vectors = topk.quantise(read(spark, sf_dir, "embeddings"), params)
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), params)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"), bpe_params())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    links = url_filter.page_links(pages)
    return url_filter.judge_urls(pages.select("page_id", "url"), links).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        r"""select * from values (-7L, 0L, 'user', r'\### Assistant: </turn> ok'),
        (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') as t(conv_id, turn, role, text)"""
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_chat(rows)
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    out = out.withColumn("__loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = quality.measured_table(docs)
    fences = quality.thresholds(quality.sketch(measured))
    return quality.judge(measured, fences).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [f"n_{k}" for k in pii.PATTERNS]
    return out.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.repair_conversations(repair.damage(read(spark, sf_dir, "conversations")))
    return out.select("conv_id", *repair.STATS, "audit", "repaired_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whitening.quantise(read(spark, sf_dir, "embeddings"))
    out = whitening.whiten(x, whitening.fit_whitening(x))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    return out.select("vec_id", "n", "deviation", "identity_error", parts).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error"
    )


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc": op2_warc,
    "op3_topk_search": op3_topk_search,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_chat_format": op9_chat_format,
    "op10_quality_rules": op10_quality_rules,
    "op11_pii": op11_pii,
    "op12_repair": op12_repair,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op2_warc": r"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages), k as (select *, max(page_id) over (partition by payload_digest) as keeper from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < keeper then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < keeper then keeper end as refers_to from k""",
    "op3_topk_search": r"""
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20""",
    "op6_line_dedup": r"""
with docs as (select doc_id, text, md5(text) as td, string_split(text, chr(10)) as lines from documents),
lines as (select doc_id, td, i, lines[i] as line, md5(lines[i]) as h, len(lines) as n from (
  select doc_id, td, lines, unnest(range(1, len(lines) + 1)) as i from (select distinct doc_id, td, lines from docs))),
cuts as (select *, case when i = n or substr(md5(coalesce(lag(h) over w, '') || h), 1, 1) in ('0','1','2','3','4','5','6','7')
  then 1 else 0 end as cut from lines window w as (partition by doc_id, td order by i)),
parts as (select *, sum(cut) over (partition by doc_id, td order by i) - cut as no from cuts),
chunks as (select doc_id, td, no, count(*) as lines, string_agg(line, chr(10) order by i) as text,
  count(*) filter (where regexp_matches(line, '[^\x20\x09-\x0D]')) as worded from parts group by all),
again as (select *, worded > 0 and row_number() over (partition by text, worded > 0 order by doc_id nulls first, td, no) > 1 as again,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words, row_number() over (partition by doc_id, td, worded > 0 order by no) as place from chunks),
run as (select *, place - row_number() over (partition by doc_id, td, again order by place) as run from again),
gone as (select *, again and (sum(worded) over w >= 2 or sum(words) over w > 50) as out from run
  window w as (partition by doc_id, td, again, run)),
kept as (select doc_id, td, sum(lines)::bigint as n_lines, coalesce(sum(lines) filter (where out), 0)::bigint as n_removed_lines,
  coalesce(count(*) filter (where out), 0)::bigint as n_removed_chunks,
  coalesce(string_agg(text, chr(10) order by no) filter (where not out), '') as left_text from gone group by doc_id, td)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed_lines, 0) as n_removed_lines,
  coalesce(n_removed_chunks, 0) as n_removed_chunks, sha256(coalesce(left_text, '')) as kept_sha256
from docs d left join kept k on d.doc_id is not distinct from k.doc_id and d.td is not distinct from k.td""",
    "op7_url_filter": r"""
with recursive page as (select page_id, url, html,
  coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
link as (select url, replace(unnest([
  regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]),
  '&amp;', '&') as dst from page where url is not null and html is not null),
whole as (select url, case when regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*://') then dst
  when starts_with(dst, '//') then regexp_extract(url, '^((?s:.*?):)//', 1) || dst
  when starts_with(dst, '/') then regexp_extract(url, '^(?s:.*?)://[^/?#]*') || dst
  else rtrim(regexp_extract(url, '^(?s:.*?)://[^/?#]*(?:[^?#]*/)?'), '/') || '/' || dst end as dst from link where dst <> ''),
node as (select distinct url, regexp_extract(url, '^((?s:.*?)://)[^/?#]*', 1)
  || translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) as node
  from (select url from page union select dst from whole) where contains(url, '://')),
edge as (select a.node as a, b.node as b from whole w join node a on a.url = w.url join node b on b.url = w.dst where a.node <> b.node),
sym as (select a, b from edge union select b, a from edge),
reach as (select a, b from sym union select r.a, s.b from reach r join sym s on r.b = s.a),
fit as (select u, host, path, case
  when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
  when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from (select distinct node as u, regexp_extract(node, '^(?s:.*?)://([^/?#]*)', 1) as host,
    regexp_extract(node, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from node)),
alias as (select r.a, bool_or(f.rule in ('example.org/en/1', 'example.org/es/', 'com/de/')) as blocked,
  bool_or(f.rule in ('org/', 'com/fr/')) as allowed from reach r join fit f on f.u = r.b group by r.a)
select p.page_id, p.host, p.path, f.rule, case when f.rule in ('org/', 'com/fr/') then 'allow' when f.rule is not null then 'block'
  when a.blocked and not coalesce(a.allowed, false) then 'block' else 'allow' end as verdict
from page p left join node n on n.url = p.url left join fit f on f.u = n.node left join alias a on a.a = n.node""",
    "op9_chat_format": r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (
  select conv_id, turn, role, text from conversations union all
  select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')),
head as (select *, case role when 'user' then 'User' when 'assistant' then 'Assistant' when 'system' then 'System'
  else '@' || replace(replace(replace(url_encode(role), '%20', '+'), '%2A', '*'), '~', '%7E') end as name, regexp_replace(text, '(### [^\s:]*: |</turn>)', '\\\1', 'g') as shown from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(name) + 2 + length(shown) + 9)::bigint as formatted_chars
from head group by conv_id""",
    "op10_quality_rules": r"""
with words as (select row_number() over () as r, doc_id, lang, source, text,
  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
pos as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from words)),
rep as (select r, count(distinct p) as n from (
  select r, unnest([i, i + 1, i + 2]) as p from (select r, i, count(*) over (partition by r, g) as c from pos) where c > 1) group by r),
line as (select r, count(*) as n, count(distinct l) as d from (
  select r, unnest(string_split(text, chr(10))) as l from words) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
base as (select words.r, doc_id, lang, source, len(w)::bigint as n_words,
  coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0)::bigint as word_chars,
  coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::bigint as n_symbols,
  coalesce(line.n - line.d, 0)::bigint as n_dup_lines, coalesce(line.n, 0) as n_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from words left join rep using (r) left join line using (r)),
rate as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  case when n_words > 0 then 1000 * n_symbols // n_words else 0 end as symbol_rate,
  case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as dup_line_rate,
  case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as repeat_rate,
  case when n_words > 0 then 1000 * word_chars // n_words else 0 end as mean_word_len from base),
long as (select lang, source, metric, v from rate unpivot (v for metric in (symbol_rate, dup_line_rate, repeat_rate, mean_word_len))
  where not base_failed),
sketch as (select lang, source, metric, (v >> s) << s as bucket, count(*) as n from (
  select *, greatest(length(ltrim(bin(v), '0')) - 6, 0) as s from long) group by all),
ranked as (select *, sum(n) over (partition by lang, source, metric order by bucket) as upto,
  sum(n) over (partition by lang, source, metric) as total from sketch),
quart as (select lang, source, metric, min(bucket) filter (where 4 * upto >= total) as q1,
  min(bucket) filter (where 4 * upto >= 3 * total) as q3 from ranked group by all),
fence as (select lang, source, max(q3 + 3 * (q3 - q1) + 300) filter (where metric = 'symbol_rate') as s,
  max(q3 + 3 * (q3 - q1) + 300) filter (where metric = 'dup_line_rate') as d,
  max(q3 + 3 * (q3 - q1) + 300) filter (where metric = 'repeat_rate') as p,
  max(q3 + 3 * (q3 - q1) + 4000) filter (where metric = 'mean_word_len') as hi,
  min(q1 - 3 * (q3 - q1) - 4000) filter (where metric = 'mean_word_len') as lo from quart group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(not base_failed and symbol_rate <= s and dup_line_rate <= d and repeat_rate <= p
    and mean_word_len <= hi and mean_word_len >= lo, false) as kept
from rate left join fence on rate.lang is not distinct from fence.lang and rate.source is not distinct from fence.source""",
    "op11_pii": twins.OP11,
    "op12_repair": twins.OP12,
}
