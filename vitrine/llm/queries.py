"""The queries opN_<name> over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm.shards import ROUNDS, SEED


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.quality import judge_documents

    return judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.topk import top_k_embeddings

    return top_k_embeddings(_table(spark, sf_dir, "embeddings"))


def op4_gbdt_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.html_main import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.shards import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op6_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.edit_counts import count_after_edits, revised

    return count_after_edits(revised(_table(spark, sf_dir, "documents")))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.mixing import mix_plan

    return mix_plan(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.jaccard import linked_components

    return linked_components(_table(spark, sf_dir, "documents"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.llm.records import write_and_read

    return write_and_read(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_crf_quality,
    op2_gru_toxicity,
    op3_exact_topk,
    op4_gbdt_main_text,
    op5_feistel_shards,
    op6_differencing_packing,
    op7_edit_token_counts,
    op8_temperature_mixing,
    op9_ngram_jaccard_join,
    op10_token_records,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Keys of the rounds of the permutation, and 2 ** 64, for SQL.
_KEYS = ", ".join(f"{(SEED * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % 2**64}::uhugeint" for k in range(ROUNDS))
_WORD = f"{2**64}::uhugeint"

ORACLE_SQL = {
    "op5_feistel_shards": f"""
with recursive tab as (  -- the remainder of each byte
  select list(c order by n) as t from (
    select n, list_reduce(list_prepend(n::ubigint, range(8)::ubigint[]), lambda c, i: case when (c & 1) = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c
    from (select unnest(range(256)) as n))
), crc as (
  select doc_id, strlen(x) + 1 as size, case when x = '' then 0::ubigint else xor(list_reduce(
    list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::ubigint)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint) end::bigint as text_crc32
  from (select doc_id, coalesce(text, '') as x from documents), tab
), r as (
  select *, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as row_number from crc
), s as (
  select n, case when n <= 2 then 1 else (floor(log2(n - 1)) + 2)::bigint // 2 end as bits from (select count(*) as n from documents)
), walk as (  -- a round at a time; from the last one on again while the place is not below n
  select row_number, (row_number >> bits)::uhugeint as l, (row_number & ((1 << bits) - 1))::uhugeint as r, 0 as k from r, s
  union all
  select row_number, r, xor(l, xor(d, d >> 33) & ((1::uhugeint << bits::uhugeint) - 1)), k from (
    select *, (xor(b, b >> 27) * 9357036318526133325::uhugeint) % {_WORD} as d from (
      select *, (xor(a, a >> 31) * 9202493588570546565::uhugeint) % {_WORD} as b from (
        select row_number, l, r, k % 6 + 1 as k, bits, (r + [{_KEYS}][k % 6 + 1]) % {_WORD} as a
        from walk, s where k < 6 or (l << bits::uhugeint) + r >= n)))
), p as (
  select row_number, ((l << bits::uhugeint) + r)::bigint as place from walk, s where k = 6 and (l << bits::uhugeint) + r < n
)
select doc_id, size, text_crc32, 'rows' as law, (place % 8)::int as shard, place // 8 as slot, null::int as grown_shard, row_number from r join p using (row_number)""",
    "op3_exact_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from (select distinct * from v) q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
  where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op9_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), e as (select a, b from l union all select b, a from l
), r as (
  select doc_id as node, doc_id as reach from documents
  union
  select r.node, e.b from r join e on e.a = r.reach
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(reach) from r where r.node = d.doc_id) as component_id
from documents d left join n using (doc_id)""",
    "op8_temperature_mixing": r"""
with recursive d as (
  select doc_id, coalesce(source, '') as src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 as n_tokens from documents
), t as (select src, sum(n_tokens)::bigint as tokens from d group by src
), p as (select src, tokens, tokens / (select sum(tokens)::double from t) as p from t
), h as (  -- target entropy: half way from the sources' own to that of equal weights
  select -sum(p * ln(p)) + 0.5 * (ln(count(*)) + sum(p * ln(p))) as target from p
), e as (  -- the exponent by entropy, bit after bit
  select 20 as bit, 0::bigint as k
  union all
  select bit - 1, k + case when (
    select ln(sum(pow(p, a))) - max(a) * sum(pow(p, a) * ln(p)) / sum(pow(p, a))
    from p, (select (k + (1 << (bit - 1))) / 1048576.0::double as a)) >= (select target from h) then 1 << (bit - 1) else 0 end
  from e where bit > 0
), x as (select k / 1048576.0::double as a from e where bit = 0
), q as (
  select src, tokens, floor(pow(p, a) / (select sum(pow(p2.p, x2.a)) from p p2, x x2) * (select sum(tokens) from t)::double)::bigint as quota from p, x
), f as (select *, quota // tokens as passes, quota % tokens as rest from q
), c as (
  select d.*, f.*exclude (src), unnest(range(0, passes + 1)) as copy from d join f using (src)
), m as (select *, md5('mix-1:' || copy || ':' || doc_id) as key from c
), u as (
  select *, sum(n_tokens) over (partition by src, copy order by key)::bigint as upto from m
), b as (
  select *, least(((copy * tokens + upto - n_tokens)::hugeint * nb // greatest(quota, 1))::bigint, nb - 1) as block
  from u, (select greatest(1, round((select sum(tokens) from t) / 65536.0))::bigint as nb)
  where copy < passes or upto <= rest
)
select doc_id, src as source, copy::int as copy, n_tokens::bigint as n_tokens, block,
  (row_number() over (partition by block order by key, src, doc_id) - 1)::int as slot from b""",
}
