"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .codes import compress_vectors
from .common import read
from .decontamination import find_contamination
from .jaccard import jaccard_join
from .langid import identify
from .mixing import mix_documents
from .packing import pack_documents
from .pii import scan_pii
from .quality_rules import quality_rules
from .secrets import scan_secrets
from .sharding import shard_documents
from .toxicity import score_toxicity
from .trie import conversation_trie
from .weak_labels import classify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
    return fn


@query
def op1_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op3_ngram_jaccard"] = r"""with recursive w as (
      select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) ws from documents),
    s as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) sh from w),
    n as (select doc_id, len(sh) as n, md5(array_to_string(sh, '|')) as code from s),
    x as (select doc_id, unnest(sh) as g from s),
    p as (select a.doc_id d1, b.doc_id d2, count(*) c from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    l as (select d1, d2, n1.code c1, n2.code c2 from p join n n1 on n1.doc_id = d1 join n n2 on n2.doc_id = d2 where 100*c >= 80*(n1.n + n2.n - c)),
    r as (select doc_id, doc_id as at from n union select r.doc_id, l.d2 from r join l on l.d1 = r.at),
    k as (select d1 as doc_id, count(distinct c2) as n_links from l where c1 <> c2 group by 1)
    select n.doc_id, n.n as n_shingles, min(r.at) as component_id, coalesce(any_value(k.n_links), 0) as n_links
    from n join r on r.doc_id = n.doc_id left join k on k.doc_id = n.doc_id group by n.doc_id, n.n"""


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


@query
def op4_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


@query
def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), shards=8)


@query
def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(read(spark, sf_dir, "documents"))


@query
def op7_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"))


@query
def op8_hashed_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


ORACLES["op11_band_trie"] = r"""with t as (
      select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, coalesce(role, '') as r, coalesce(text, '') as x
      from conversations where conv_id is not null),
    k as materialized (select c, c - c % 20 as b, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda v: ord(v)::bigint)),
        lambda a, v: list_reduce(list_prepend(xor(a, v), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 as h
      from (select distinct c from t)),
    f as (select k.c, 0 as own, t.pos, t.r, t.x from k join t on t.c = k.b and t.pos <= k.h union all select k.c, 1, t.pos, t.r, t.x from k join t on t.c = k.c and t.pos > k.h),
    g as (select c, row_number() over (partition by c order by own, pos) as d, md5(r || chr(1) || x) as code, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as w from f),
    s as materialized (select k.c, coalesce(list(g.code order by g.d) filter (g.d is not null), []) as path, coalesce(list(g.w order by g.d) filter (g.d is not null), []) as ws
      from k left join g on g.c = k.c group by k.c),
    m as materialized (select c, depth, md5(array_to_string(path[1:depth], '|')) as id, case when depth > 0 then md5(array_to_string(path[1:depth - 1], '|')) end as up,
      case when depth > 0 then ws[depth] else 0 end as w, depth = len(path) as ends from (select *, unnest(range(0, len(path) + 1)) as depth from s)),
    n as materialized (select id, depth, any_value(up) as up, min(c) as conv_id, count(*) as n_convs, max(w) as w,
      sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256 from m group by id, depth),
    j as materialized (select up as id, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all),
    v as materialized (select n.*, coalesce(n_children, 0) as n_children from n left join j using (id, depth)),
    u as (select a.id, a.depth, sum((v.n_children = 0)::int) as n_leaves, sum((v.n_convs - 1) * v.w) as saved_tokens
      from v join m on m.c = v.conv_id and m.depth <= v.depth join v a on a.id = m.id and a.depth = m.depth group by all)
    select v.conv_id, v.depth::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, u.n_leaves::bigint as n_leaves, u.saved_tokens::bigint as saved_tokens, v.ends_sha256
    from v join u using (id, depth) left join v p on p.id = v.up and p.depth = v.depth - 1"""


@query
def op11_band_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))


def _code_rounds(rounds: int = 4) -> str:
    """The rounds of op12 in SQL: whole components stay exact in doubles."""
    near = """a{n} as materialized (select vec_id, label, part, x, min({{'d': xx - 2 * list_inner_product(x, c) + cc, 'e': e}}) as m
      from p join b{n} using (part) group by all)"""
    step = """b{m} as materialized (with u as (select part, m.e as e, unnest(x) as v, unnest(range(1, len(x) + 1)) as i from a{n}),
        f as (select part, e, i, floor(sum(v) / count(*)) as v from u group by all), g as (select part, e, list(v order by i) as c from f group by all)
      select part, e, coalesce(g.c, b.c) as c, list_inner_product(coalesce(g.c, b.c), coalesce(g.c, b.c)) as cc from b{n} b left join g using (part, e))"""
    parts = [near.format(n=0)]
    for n in range(rounds):
        parts += [step.format(n=n, m=n + 1), near.format(n=n + 1)]
    return ", ".join(parts)


ORACLES["op12_slice_codes"] = f"""with k as (
      select vec_id, label, list_transform(embedding, lambda v: floor(v::double * 1024)) as v from embeddings
      where embedding is not null and not list_contains(list_transform(embedding, lambda v: coalesce(isfinite(v), false)), false)),
    p as materialized (select vec_id, label, part, x, list_inner_product(x, x) as xx from (
      select vec_id, label, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] as x from k, range(4) as r(part))),
    b0 as materialized (select part, e, x as c, xx as cc from (select *, row_number() over (partition by part order by vec_id) - 1 as e from p) where e < 256),
    {_code_rounds()},
    f as (select vec_id, label, string_agg(printf('%02x', m.e), '' order by part) as code, sum(m.d)::bigint as error from a4 group by all),
    h as (select sha256(string_agg(array_to_string(list_transform(c, lambda v: v::bigint::varchar), ','), ',' order by part, e)) as codebooks_sha256 from b4)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from f, h"""

@query
def op12_slice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read(spark, sf_dir, "embeddings"))


ORACLES["op13_source_mix"] = r"""with recursive d as (
      select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
        ('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'text:' || coalesce(text, ''))), 1, 13))::bigint / 4503599627370496.0::double as toss from documents),
    s as (select source, sum(size)::bigint as size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by source),
    k as (select sum(size)::bigint as whole from s),
    g as (select 0 as i, (whole::double / (select sum(w) from s)) as rate, 0 as stopped from k
      union all select i + 1, (whole - held)::double / wide, n from (
        select g.i, k.whole, g.stopped, coalesce(sum(3 * s.size) filter (g.rate * s.w > 3 * s.size), 0) as held,
          sum(s.w) filter (g.rate * s.w <= 3 * s.size) as wide, count(*) filter (g.rate * s.w > 3 * s.size) as n
        from g, k, s group by all) where n > stopped and wide > 0),
    f as (select rate from g order by i desc limit 1),
    t as (select source, size as source_size, least(f.rate * w, 3 * size)::double as target from s, f),
    r as (select *, case when source_size > 0 then least(target / source_size, 3.0::double) else 0.0::double end as rate from t),
    c as (select d.doc_id, d.size, r.source_size, r.target, d.source, (floor(r.rate) + (d.toss < r.rate - floor(r.rate))::int)::int as copies
      from d join r on d.source is not distinct from r.source)
    select doc_id, size::bigint as size, source_size, target, size * copies as taken, source, copies from c"""


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read(spark, sf_dir, "documents"))
