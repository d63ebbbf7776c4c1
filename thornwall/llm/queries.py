"""The operators as queries over the tables, each over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thornwall.llm import ann, chunks, clusters, decontam, langid, lines, packing, repair, shards, simhash, toxicity, warc, wavelet


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), words=3, radius=3)


def op2_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(_table(spark, folder, "embeddings"), k=20, every=20)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = _tokenizer("byte_bpe_50k.json")
    return packing.pack(_table(spark, folder, "documents"), tokenizer, capacity=1024, end_id=0)


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_report(_table(spark, folder, "documents"), per_language=400)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, folder, "documents"), _table(spark, folder, "labels"), threshold=0.7)


def op7_wavelet(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.token_files(_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_report(_table(spark, folder, "pages"), min_bytes=0)


def op9_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_by_bytes(_table(spark, folder, "documents"), shards=24)


def op10_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(_table(spark, folder, "documents"), min_chars=10)


def op11_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.exact_duplicates(_table(spark, folder, "documents"))


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.cluster(_table(spark, folder, "embeddings"), k=16, rounds=3, size=64, scale=64)


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_report(repair.damage(_table(spark, folder, "conversations")))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_multi_index": op2_multi_index,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_wavelet": op7_wavelet,
    "op8_warc": op8_warc,
    "op9_shards": op9_shards,
    "op10_lines": op10_lines,
    "op11_recipes": op11_recipes,
    "op12_clusters": op12_clusters,
    "op13_repair": op13_repair,
}

def _clusters_sql(rounds: int) -> str:
    """The rounds of clustering one after the other, every vector against every centroid."""
    parts = ["""
with kept as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as cells
    from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as (
    select row_number() over (order by sha256('1:' || vec_id)) - 1 as number, cells as centre
    from kept order by sha256('1:' || vec_id) limit 16
)"""]
    for n in range(rounds + 1):
        parts.append(f""", d{n} as (
    select vec_id, number, any_value(cells) as cells,
        sum((cells[i] - centre[i]) * (cells[i] - centre[i]))::bigint as distance
    from kept, c{n}, range(1, 65) as places(i) group by vec_id, number
), a{n} as (
    select vec_id, cells, number, distance from d{n}
    qualify row_number() over (partition by vec_id order by distance, number) = 1
), c{n + 1} as (
    select c.number, case when count(a.vec_id) = 0 then any_value(c.centre) else list_transform(range(1, 65),
        lambda i: cast(floor(list_sum(list_transform(list(a.cells), lambda v: v[i])) / count(a.vec_id)) as bigint)) end as centre
    from c{n} c left join a{n} a on a.number = c.number group by c.number
)""")
    parts.append(f"""
select a.vec_id, a.number::int as cluster, a.distance, sum(a.distance) over (partition by a.number)::bigint as cluster_inertia,
    sum(a.distance) over ()::bigint as inertia, sha256(array_to_string(c.centre, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.number = c.number""")
    return "".join(parts)


#: Queries that SQL can express; the others are tested against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op10_lines": """
with lined as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
), keyed as (
    select doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
    from lined
), marked as (
    select doc_id, pos, line,
        length(line_key) < 10 or doc_id = min(doc_id) over (partition by line_key) as stays
    from keyed
)
select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (stays), '')) as kept_sha256
from marked group by doc_id
""",
    "op11_recipes": """
with folded as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents
)
select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
    doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from folded
""",
    "op12_clusters": _clusters_sql(rounds=3),
}
