"""Queries of the operators over the tables of a folder, each with the operator's production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, line_dedup, ngram_join, packing, pii, sharding, tiff, toxicity


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encode_decode(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.group_table(_documents(spark, folder), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("content_hash").alias("text_sha256"))


def op3_tiff(spark: SparkSession, folder: str) -> DataFrame:
    stored = tiff.store(_documents(spark, folder), keep=["doc_id"])
    tail = F.expr("substring(payload, -64, 64)")
    return stored.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "pages",
    )


def tiff_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each page of the files that ``op3_tiff`` stores."""
    pages = tiff.read_pages(tiff.store(_documents(spark, folder), keep=["doc_id"]).select("doc_id", "media"))
    return pages.select("doc_id", "page", "width", "height", "channels", "bits", "compression", "predictor", "tiled", "error", F.sha2("samples", 256).alias("samples_sha256"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(_documents(spark, folder), shards=8)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.with_predictions(docs, model)


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    found = line_dedup.cleaned_with_counts(docs)
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(_documents(spark, folder))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), max_len=2048, keep=["doc_id"])
    return packed.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    found = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def _count_of(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_documents(spark, folder), keep=["doc_id"])
    counts = [_count_of(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_tiff": op3_tiff,
    "tiff_pages": tiff_pages,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_langid": op9_langid,
    "op10_pii": op10_pii,
}

_UPPER, _LOWER = exact_dedup.UPPER, exact_dedup.LOWER

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        select doc_id, max(doc_id) over same as keep_id, cast(count(*) over same as bigint) as group_size,
               doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
        from (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents) d
        window same as (partition by t)""",
    # The checksum by its 256-entry table over the text's UTF-8 bytes; the jumps by recursion modulo 2**64.
    "op4_sharding": """
        with recursive bits(i, c, k) as (select i, i, 0 from range(256) t(i) union all
            select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
        crc as (select list(c order by i) as t from bits where k = 8),
        points as (select doc_id, list_transform(string_split(coalesce(text, ''), ''), lambda x: case when x = '' then null else ord(x)::bigint end) as p from documents),
        bytes as (select doc_id, flatten(list_transform(p, lambda u: case when u is null then []::bigint[] when u < 128 then [u] when u < 2048 then [192 + (u >> 6), 128 + (u & 63)]
            when u < 65536 then [224 + (u >> 12), 128 + ((u >> 6) & 63), 128 + (u & 63)]
            else [240 + (u >> 18), 128 + ((u >> 12) & 63), 128 + ((u >> 6) & 63), 128 + (u & 63)] end)) as b from points),
        sums as (select doc_id, cast(len(b) + 1 as bigint) as size, cast(xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as bigint) as text_crc32 from bytes, crc),
        jump(doc_id, n, state, shard, next) as (
            select doc_id, n, cast(coalesce(doc_id, 0) as hugeint) + case when doc_id < 0 then 18446744073709551616 else 0 end, -1::bigint, 0::bigint from documents, (values (8), (9)) v(n)
            union all
            select doc_id, n, s, next, cast(floor((next + 1) * (cast(2147483648 as double) / (cast(s // 8589934592 as double) + 1))) as bigint)
            from (select *, (state * 2862933555777941757 + 1) % 18446744073709551616 as s from jump where next < n) q),
        placed as (select doc_id, cast(max(shard) filter (n = 8) as int) as shard, cast(max(shard) filter (n = 9) as int) as grown_shard from jump group by 1)
        select s.doc_id, size, text_crc32, 'key' as law, shard, cast(row_number() over (partition by shard order by s.doc_id nulls first) - 1 as bigint) as slot, grown_shard from sums s join placed p on s.doc_id is not distinct from p.doc_id""",
    # Of each line the shortest runs of 50 words that start or end at it; equal runs but the first are later copies.
    "op6_line_dedup": r"""
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as content, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as line from documents),
        w as (select *, len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) as words from l),
        c as materialized (select *, sum(words) over (partition by doc_id order by line) as upto from w),
        ends as (select a.doc_id, a.line as i, min(b.line) as j from c a join c b on a.doc_id = b.doc_id and b.line >= a.line and b.upto - a.upto + a.words >= 50 group by 1, 2
            union
            select b.doc_id, max(a.line), b.line from c a join c b on a.doc_id = b.doc_id and b.line >= a.line and b.upto - a.upto + a.words >= 50 group by 1, 3),
        runs as materialized (select e.doc_id, e.i, e.j, string_agg(c.content, chr(10) order by c.line) as run from ends e join c on c.doc_id = e.doc_id and c.line between e.i and e.j group by 1, 2, 3),
        later as (select doc_id, i, j, row_number() over (partition by run order by doc_id, i) as nth from runs),
        dead as (select distinct c.doc_id, c.line from later r join c on c.doc_id = r.doc_id and c.line between r.i and r.j where nth > 1)
        select c.doc_id, count(*) as n_lines, count(d.line) as n_deleted, sha256(coalesce(string_agg(c.content, chr(10) order by c.line) filter (d.line is null), '')) as text_sha256
        from c left join dead d on d.doc_id = c.doc_id and d.line = c.line group by 1""",
    # Every pair of sets that share a run of words, by counting the runs in common.
    "op7_ngram_join": r"""
        with recursive d as materialized (select doc_id, lower(coalesce(text, '')) as t, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN][\pL\pN\pM]*') as w from documents),
        s as materialized (select doc_id, case when len(w) = 0 then ['raw', t] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g, len(w) as n from d),
        k as materialized (select doc_id, len(g) as size, n = 0 as wordless, sha256(array_to_string(list_sort(g), '|')) as class, g from s),
        u as materialized (select class, any_value(size) as size, count(*) as copies, min(doc_id) as least, any_value(g) as g from k group by class, wordless),
        x as materialized (select class, size, unnest(g) as shingle from u),
        p as (select a.class as a, b.class as b, count(*) as common, any_value(a.size) as m, any_value(b.size) as n from x a join x b on a.shingle = b.shingle and a.class < b.class group by 1, 2),
        links as materialized (select a, b from p where common >= 0.8 * (m + n - common) - 1e-9 union all select b, a from p where common >= 0.8 * (m + n - common) - 1e-9),
        reach(root, node) as (select class, class from u union select root, b from reach join links on a = node),
        part as materialized (select node as class, min(least) as class_id, sum(copies) as class_size from reach join u on u.class = root group by 1),
        deg as (select a as class, sum(copies) as rows, count(*) as texts from links join u on u.class = b group by 1)
        select k.doc_id, class_id, cast(class_size as bigint) as class_size, cast(u.copies - 1 + coalesce(rows, 0) as bigint) as n_links, cast(coalesce(texts, 0) as bigint) as n_linked_texts
        from k join u using (class) join part using (class) left join deg using (class)""",
}
