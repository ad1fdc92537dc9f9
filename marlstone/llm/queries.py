"""The digest queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import classifier, html_text, lines, mixing, packing, pseudo_lm, quality, simhash, topk, unigram


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_top_k": op9_top_k,
    "op10_lm_scoring": op10_lm_scoring,
}
#: DuckDB SQL with the rows of the query of the same name.
ORACLES: dict[str, str] = {
    "op3_quality_rules": r"""
with texts as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents
), parsed as (
  select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(regexp_split_to_array(lower(t), '[^\p{L}]+'), lambda x: x <> '') as letters,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    regexp_replace(t, '[\p{L}0-9]+', '', 'g') as rest, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as upper
  from texts
), counted as (
  select *, length(t) as n_chars, length(t) - length(rest) as plain,
    length(rest) - length(regexp_replace(rest, '[\x20\x09-\x0D]+', '', 'g')) as spaces,
    length(rest) - length(regexp_replace(rest, '[.,;:''"()\-]+', '', 'g')) as marks,
    length(rest) - length(regexp_replace(rest, '[!?]+', '', 'g')) as cries
  from parsed
), running as (
  select lang, word, count(*) as n from (select lang, unnest(letters) as word from parsed) group by all
), sizes as (
  select lang from running where lang is not null group by lang having sum(n) * 100 >= (select sum(n) from running)
), grouped as (
  select *, case when lang in (select lang from sizes) then lang else 'other' end as g from counted
), often as (
  select case when lang in (select lang from sizes) then lang else 'other' end as g, word, sum(n) as n from running group by all
), common as (
  select g, word, n / total as q from (select *, sum(n) over (partition by g) as total from often) where n * 200 >= total
), shares as (
  select rid, g, n_chars, unnest([upper, plain - upper, spaces, marks, cries, n_chars - plain - spaces - marks - cries]) as n,
    unnest([0, 1, 2, 3, 4, 5]) as class from grouped where n_chars > 0
), medians as (
  select g, class, case when bin < 1000 then (bin + 0.5) / 1000 else 1.0 end as q
  from (select *, row_number() over (partition by g, class order by bin) as place, count(*) over (partition by g, class) as many
        from (select g, class, n * 1000 // n_chars as bin from shares))
  where place = (many + 1) // 2
), classes as (
  select s.rid, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as class_distance
  from (select rid, g, class, n / n_chars as p from shares) s join (select g, class, q::double / sum(q::double) over (partition by g) as q from medians) m on s.g = m.g and s.class = m.class
  group by s.rid
), per_word as (
  select d.rid, c.word, c.q, coalesce(o.n, 0) / len(d.letters) as p
  from grouped d join common c on c.g = d.g
  left join (select rid, word, count(*) as n from (select rid, unnest(letters) as word from grouped) group by all) o on o.rid = d.rid and o.word = c.word
  where len(d.letters) > 0
), with_rest as (
  select rid, p, q from per_word union all
  select rid, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) from per_word group by rid
), common_distances as (
  select rid, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as word_distance
  from with_rest group by rid
), windows as (
  select rid, i, list_slice(w, i, i + 7) as gram from (select rid, w, unnest(range(1, len(w) - 6)) as i from parsed where len(w) > 8)
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, gram) as n from windows) where n > 1
), repeats as (
  select rid, count(distinct j) as n from (select rid, unnest(range(i, i + 8)) as j from twice) group by rid
), joined as (
  select doc_id, len(w)::bigint as n_words, (n_chars - spaces)::bigint as word_chars,
    (length(rest) - length(regexp_replace(rest, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
    n_chars, len(letters) as n_letters, class_distance, word_distance
  from grouped d left join repeats r on r.rid = d.rid left join classes c on c.rid = d.rid left join common_distances x on x.rid = d.rid
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)
    and not coalesce(n_chars >= 60 and class_distance > 0.17 or n_letters >= 30 and word_distance > 0.4, false) as kept,
  class_distance, word_distance
from joined
""",
    "op9_top_k": """
with sound as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.rid, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from sound q join sound c on q.rid <> c.rid and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from pairs)
where rank <= 5
""",
}
