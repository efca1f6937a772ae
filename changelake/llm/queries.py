"""Registered queries of the operators, on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.llm import (bit_sliced, chunk_dedup, hilbert, html_extract, ngram_join, packing, prefix_trie,
                            source_audit, source_mix, suffix_dedup, toxicity, trie_bpe, url_filter)

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "rejected")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"), ngram_join.Rule(4, 85, 100))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge(pages, url_filter.page_links(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "method")


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), 4096)


def op8_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400).drop("kept")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), repeats=3)
    return mixed.documents.select("doc_id", "source", "size", "source_size", "target", "taken")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_ngram_join, op3_html_extract, op4_hilbert_neighbours, op5_url_filter, op6_chunk_dedup,
    op7_packing, op8_trie_bpe, op9_bit_sliced, op10_suffix_dedup, op11_source_mix,
    op12_source_audit, op13_prefix_trie)}

_QUANTISED = """select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""

CHECKS = {
    "op9_bit_sliced": f"""
        with v as ({_QUANTISED}),
        s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q),
                  lambda p: p[1] * p[2])) as bigint) as score
              from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
        select query_id, cast(rank as int) as rank, vec_id, score from (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        where rank <= 5""",
    # A source is capped if, with all that stop earlier taken out, its share would still be too much.
    "op11_source_mix": r"""
        with d as (
          select doc_id, source, md5(concat('mix:', coalesce(cast(doc_id as varchar), ''), ':', coalesce(text, ''))) mark,
                 cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
        s as (
          select *, rank % 3 + 1 as weight, cast(3 * source_size as hugeint) most, sum(source_size) over () as budget
          from (select source, cast(sum(size) as bigint) source_size,
                       row_number() over (order by source nulls last) - 1 as rank from d group by source)),
        o as (
          select *, most * (6 // weight) as turn from s),
        f as (
          select *, most * sum(weight) over (order by turn, rank rows between current row and unbounded following)
                    <= weight * (budget - coalesce(sum(most) over (
                       order by turn, rank rows between unbounded preceding and 1 preceding), 0)) as capped from o),
        t as (
          select source, source_size, rank, budget, case when capped then cast(most as double) else
                 cast(weight * (budget - coalesce(sum(most) filter (capped) over (), 0)) as double)
                 / sum(weight) filter (not capped) over () end as target from f),
        e as (
          select *, floor(target) as low, budget - sum(floor(target)) over () as spare, row_number() over (
                 order by case when ceil(target) > floor(target) then (floor(target) + 1) / target end nulls last, rank) as turn
          from t),
        v as (
          select source, source_size, target,
                 cast(low + case when ceil(target) > low and turn <= spare then 1 else 0 end as bigint) served from e),
        p as (
          select d.*, cast(coalesce(sum(size) over (partition by source order by mark, doc_id, size
                 rows between unbounded preceding and 1 preceding), 0) as bigint) as start from d)
        select doc_id, p.source, size, source_size, target,
               greatest(0, least(size, served - start)) + greatest(0, least(size, served - source_size - start))
               + greatest(0, least(size, served - 2 * source_size - start)) as taken
        from p join v on p.source is not distinct from v.source""",
    "op12_source_audit": r"""
        with d as (
          select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        w as (
          select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        kept as (
          select lang, term, count(*) as whole from w group by lang, term having count(distinct id) >= 30),
        l as (
          select lang, count(*) as v, sum(whole) as n from kept group by lang),
        c as (
          select lang, source, term, count(*) as cnt from w semi join kept using (lang, term) group by all),
        g as (
          select g.lang, g.source, coalesce(t.n, 0) as n, coalesce(l.v, 0) as v, coalesce(l.n, 0) as lang_n
          from (select distinct lang, source from d) g left join l on g.lang = l.lang
          left join (select lang, source, sum(cnt) as n from c group by lang, source) t
            on g.lang = t.lang and g.source = t.source),
        p as (
          select g.lang, g.source, kept.term, coalesce(cnt, 0) as cnt,
                 1 + (1000000000 * (coalesce(cnt, 0) + 5)::hugeint) // (g.n + 5 * v) as p,
                 1 + (1000000000 * (whole + 5)::hugeint) // (lang_n + 5 * v) as q
          from g join kept on g.lang = kept.lang
          left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
        r as (
          select a.lang, a.source, 'pair' as part, b.source as item,
                 coalesce((select sum(abs(x.p - y.p)) from p x join p y on x.lang = y.lang and x.term = y.term
                           where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source
          union all
          select lang, source, 'term', term, p - q from p where cnt > 0 and p > q)
        select * from (
          select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (
            partition by lang, source, part order by value desc, item) as int) as rank from r)
        where part = 'pair' or rank <= 50""",
    # The checksum bit by bit, since there is no function for it.
    "op13_prefix_trie": r"""
        with t as (
          select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
                 coalesce(text, '')) as pos, concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) as cell,
                 strlen(coalesce(text, '')) as bytes
          from conversations where conv_id is not null),
        c as (
          select conv_id, n, conv_id - conv_id % 5 as first, xor(list_reduce(list_prepend(cast(4294967295 as bigint),
                 list_transform(range(0, 8 * length(conv_id::varchar)), lambda i: case when i % 8 = 0
                   then cast(ord(substr(conv_id::varchar, cast(i // 8 + 1 as bigint), 1)) as bigint) else 0 end)),
                 lambda s, x: case when xor(s, x) % 2 = 1 then xor(xor(s, x) // 2, 3988292384) else xor(s, x) // 2 end),
                 4294967295) % 9 as h
          from (select conv_id, max(pos) as n from t group by conv_id)),
        f as (
          select c.*, least(c.h, coalesce(o.n, 0)) as m from c left join c o on o.conv_id = c.first),
        r as (
          select f.conv_id, pos as depth, cell, bytes from f join t on t.conv_id = f.first and pos <= h
          union all
          select f.conv_id, m + pos - h, cell, bytes from f join t on t.conv_id = f.conv_id and pos > h),
        p as (
          select conv_id, depth, bytes, sha256(string_agg(sha256(cell), '') over (
                 partition by conv_id order by depth)) as key from r
          union all select conv_id, 0, 0, '' from f),
        n as (
          select key, depth, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes from p group by key, depth),
        e as (
          select key, string_agg(conv_id::varchar, ',' order by conv_id) as ids
          from (select conv_id, arg_max(key, depth) as key from p group by conv_id) group by key),
        u as (
          select n.*, o.conv_id as parent_conv_id, o.key as parent from n
          left join p on p.conv_id = n.conv_id and p.depth = n.depth - 1 left join n o on o.key = p.key),
        k as (select parent as key, count(*) as n_children from u where parent is not null group by parent),
        s as (
          select p.key, sum(case when k.key is null then 1 else 0 end) as n_leaves,
                 sum((n.n_convs - 1) * n.bytes) as saved_tokens
          from n left join k on n.key = k.key join p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.key)
        select u.conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs,
               coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves,
               cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
        from u left join k on u.key = k.key join s on u.key = s.key left join e on u.key = e.key""",
}
