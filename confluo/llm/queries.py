"""The queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from confluo.llm.common import read_table

#: Fixed value: the tokenizer of the contracts.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.substring_dedup import dedup_substrings

    return dedup_substrings(read_table(spark, sf_dir, "documents"), texts=False).drop("spans")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.common import KEY
    from confluo.llm.quality_classifier import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop(KEY)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.common import KEY
    from confluo.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).drop(KEY, "copies")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.license_scan import scan

    return scan(read_table(spark, sf_dir, "documents")).drop("spans")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.common import KEY
    from confluo.llm.decontamination import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop(KEY)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.common import KEY
    from confluo.llm.jaccard_join import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).drop(KEY, "component")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.token_output import token_files

    return token_files(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("strength")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.divergence import divergence

    return divergence(read_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.suffix_dedup import PASSAGE, dedup_repeats

    return dedup_repeats(read_table(spark, sf_dir, "documents"), texts=False, passage=PASSAGE)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """What the contract of periodic runs makes of a document's words: in a tenth of the documents, by a checksum of the id, the
    words from a place on repeat its next few words. A null id changes nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    return words[:at] + [words[at + i % period] for i in range(n - at)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from confluo.llm.periodic_runs import find_runs

    return find_runs(read_table(spark, sf_dir, "documents"), texts=False, change=repeat_tail)


OP5_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || coalesce(text, '')), 1, 13) as bigint)::double + 0.5)
      / 4503599627370496.0::double as u
  from documents),
e as (select doc_id, source, size, u, length(bin(size)) as g, count(*)::bigint as n from d group by all),
s as (select source, sum(n * size)::bigint as source_size from e group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s),
c as (select *, source_size * 3 as cap, (source_size * 3) / w::double as stop from w),
l as (select *, (sum(source_size) over () - (sum(cap) over (order by stop, source nulls last rows unbounded preceding) - cap))::double
    / (sum(w) over () - (sum(w) over (order by stop, source nulls last rows unbounded preceding) - w))::double as level from c),
f as (select level as final from l where level <= stop order by stop, level limit 1),
t as (select source, source_size, least(cap::double, w::double * final) as target from l, f),
p as (select *, case when source_size = 0 then 0 else floor(target / source_size::double) end::bigint as whole from t),
o as (select *, target - (whole * source_size)::double as open_words from p),
k as (select e.source, g, any_value(open_words) as open_words, sum(n * size) as words
  from e join o on e.source is not distinct from o.source group by e.source, g),
v as (select *, (open_words - coalesce(sum(words) over (partition by source order by g desc rows between unbounded preceding and 1 preceding), 0)::double)
    / nullif(sum(g * words) over (partition by source order by g desc rows between current row and unbounded following), 0)::double as level from k),
i as (select source, max_by(level, g) as level from v where level >= 0 and level * g::double <= 1 group by source),
q as (select e.*, o.* exclude (source), least(1.0::double, coalesce(level, 0)::double * g::double) as p
  from e join o on e.source is not distinct from o.source left join i on e.source is not distinct from i.source),
r as (select *, case when p <= 0 then 1.0::double else (u / (1 - u)) * ((1 - p) / p) / (1 + (u / (1 - u)) * ((1 - p) / p)) end as v from q),
h as (select *, sum(n * size) over (partition by source order by v, u, doc_id rows unbounded preceding) as upto from r),
a as (select *, row_number() over (partition by source, upto::double > open_words order by v, u, doc_id) as place from h),
b as (select *, case when open_words <= 0 then 0 when upto::double <= open_words then n
    when place = 1 and size > 0 then floor((open_words - (upto - n * size)::double) / size::double) else 0 end::bigint as extra from a),
x as (select source, any_value(open_words) - sum(extra * size)::double as rest from b group by source),
m as (select b.*, abs(size::double - rest) as gap, open_words > 0 and extra < n and abs(size::double - rest) < rest as may
  from b join x on b.source is not distinct from x.source),
z as (select *, row_number() over (partition by source, may order by length(bin(floor(gap)::bigint)), v, u, doc_id) as nth from m),
y as (select *, extra + case when may and nth = 1 then 1 else 0 end as more from z)
select doc_id, size, source_size, target, ((whole + case when unnest(range(1, n + 1)) <= more then 1 else 0 end) * size)::bigint as taken from y
"""


#: Whole numbers: hugeint holds each product.
OP11_SQL = r"""
with d as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row from documents),
w as (select lang, source, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*)::bigint as n, count(distinct row)::bigint as docs from w group by all),
k as (select lang, term, sum(n)::hugeint as q from c group by all having sum(docs) >= 10),
l as (select lang, count(*)::hugeint as v, sum(q)::hugeint as qn from k group by lang),
g as (select lang, source, sum(coalesce(n, 0))::hugeint as total from (select distinct lang, source from d) left join (c join k using (lang, term)) using (lang, source) group by all),
f as (select g.lang, g.source, term, coalesce(c.n, 0)::hugeint as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (total + 2 * v) as p,
    1 + (1000000000::hugeint * (k.q + 2)) // (qn + 2 * v) as q from g join l using (lang) join k using (lang) left join c using (lang, source, term)),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from f a join f b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
e as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from f where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from e)
select * from r where part = 'pair' or rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_substring_dedup, op4_quality_classifier, op5_mixing, op6_license_scan, op7_decontamination, op8_jaccard_join, op9_token_output, op10_toxicity, op11_divergence, op12_suffix_dedup, op13_periodic_runs, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5_SQL, "op11_divergence": OP11_SQL}
