"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from countcast.llm import decontaminate, jaccard_join, language_id, license_scan, periodic_runs, quality_classifier, quality_rules, secret_scan, sentence_pieces, substring_dedup, token_files, va_file, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.token_index(spark, _table(spark, sf_dir, "documents"), vocabulary)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.digests(_table(spark, sf_dir, "documents"), model)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_index(spark, _table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "common_words", "passage_words", "answer_found")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.summaries(_table(spark, sf_dir, "documents"), edit=periodic_runs.with_planted_run)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.summary(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_files": op3_token_files,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_language_id": op11_language_id,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroid_clusters": op13_centroid_clusters,
}

#: Words as the operators see them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _letters(pattern: str) -> str:
    return f"length(regexp_replace(coalesce(text, ''), '[^{pattern}]', '', 'g'))"


def _rounds(n: int) -> str:
    """``n`` rounds of assigning vectors (v0) to centroids (c0) and moving these."""
    assign = """a{i} as materialized (
  select r, c, dist from (
    select r, c, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as dist
    from v0, c{i}) qualify row_number() over (partition by r order by dist, c) = 1)"""
    move = """c{j} as materialized (
  select c, coalesce(m, w) as w from c{i} left join (
    select c, list((s - ((s % n) + n) % n) // n order by d) as m from (
      select c, d, sum(x)::bigint as s, count(*)::bigint as n from (
        select c, unnest(v) as x, unnest(range(64)) as d from a{i} join v0 using (r)) group by c, d) group by c) using (c))"""
    steps = [s.format(i=i, j=i + 1) for i in range(n) for s in (assign, move)]
    return ",\n".join([*steps, assign.format(i=n)])


SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
windows as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select r, w, unnest(range(1, len(w) - 1)) as i from d)),
again as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from windows) where n > 1),
covered as (
  select r, count(distinct j) as n_repeat_words from (select r, i + unnest([0, 1, 2]) as j from again) group by r),
lines as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
counts as (
  select d.r, doc_id, text, len(w) as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    {_letters('#*$%&|<>')} as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as n_lettered,
    {_letters('A-Z')} as n_upper, {_letters('A-Za-z')} as n_letters, {_letters('!')} as n_exclaimed
  from d left join lines using (r) left join covered using (r)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or 100 * n_dup_lines > 35 * n_lines or 2 * n_upper > n_letters
    or 10 * n_exclaimed > n_words or 10 * n_lettered < 8 * n_words
    or 2 * word_chars < 5 * n_words or word_chars > 15 * n_words) as kept
from judged""",
    "op4_ngram_jaccard_join": rf"""
with recursive d as (
  select row_number() over () as r, doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
shingles as materialized (
  select distinct r, array_to_string(w[i + 1:least(i + 5, len(w))], ' ') as g
  from (select r, w, unnest(range(greatest(1, len(w) - 4))) as i from d where len(w) > 0)),
sizes as (select r, count(*) as n from shingles group by r),
links as materialized (
  select a, b from (select x.r as a, y.r as b, count(*) as shared from shingles x join shingles y using (g) where x.r <> y.r group by 1, 2)
  join sizes p on p.r = a join sizes q on q.r = b where 100 * shared >= 75 * (p.n + q.n - shared)),
reach as (select r, r as other from d union select reach.r, b from reach join links on other = a)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(o.doc_id) as component_id
from reach join d on d.r = reach.r join d o on o.r = other left join sizes on sizes.r = d.r group by d.r, d.doc_id""",
    "op8_warc": r"""
with p as (select page_id, coalesce(html, '') as body, row_number() over (partition by coalesce(html, '') order by page_id desc nulls last) as k,
    first_value(page_id) over (partition by coalesce(html, '') order by page_id desc nulls last) as best from pages),
h as (select *, sha1(body) as hex, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' as letters from p)
select page_id, strlen(body)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    letters[1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::int >> (15 - 5 * (i % 4))::int) & 31)]), '') as payload_digest,
  case when k = 1 then 'response' else 'revisit' end as record_type,
  case when k > 1 then best end as refers_to
from h""",
    "op12_periodic_runs": r"""
with codes as (
  select doc_id, h from (
    select doc_id, 4294967295 - list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::varchar, ''),
      lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as h
    from documents) group by all),
given as (
  select row_number() over () as r, doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents left join codes using (doc_id)),
sizes as (select *, len(w) as n, (h // 10) % len(w) as a, (h // 10) % 8 as g, coalesce(h % 10 = 0, false) and len(w) > 0 as planted from given),
texts as materialized (
  select r, doc_id, n, case when planted then list_transform(range(n), lambda i: case when i < a then w[i + 1]
    else w[(a + (i - a) % (1 + (n - a) // (3 + g)) + 1)::bigint] end) else w end as w from sizes),
words as materialized (select r, n, unnest(w) as x, unnest(range(n)) as i from texts),
agree as (
  select a.r, a.i, b.i - a.i as p, a.i - row_number() over (partition by a.r, b.i - a.i order by a.i) as island
  from words a join words b on a.r = b.r and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n),
stretches as (select r, p, min(i) as start, count(*) + p as length from agree group by r, p, island having count(*) + p >= greatest(6, 4 * p)),
runs as materialized (select r, start::bigint as start, length::bigint as length, min(p)::bigint as period from stretches group by r, start, length),
listed as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from runs group by r),
best as (
  select r, start, length, period from runs
  qualify row_number() over (partition by r order by length::decimal(38, 18) / period desc, start, period) = 1),
dropped as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (select r, string_agg(x, ' ' order by i) as words from words anti join dropped using (r, i) group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start, length, period, (1000 * length // period)::bigint as exponent_milli,
  sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from texts left join listed using (r) left join best using (r) left join kept using (r)""",
    "op13_centroid_clusters": f"""
with v0 as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (
  select row_number() over (order by h, v) - 1 as c, v as w from (
    select sha256('2:' || coalesce(vec_id::varchar, '')) as h, v from v0 order by h, v limit 40)),
{_rounds(5)}
select vec_id, c::int as cluster, dist as distance, (sum(dist) over (partition by c))::bigint as cluster_inertia,
  (sum(dist) over ())::bigint as inertia, sha256(list_aggregate(w, 'string_agg', ',')) as centroid_sha256
from a5 join c5 using (c) join v0 using (r)""",
}
