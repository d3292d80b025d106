"""Queries opN_<name>: each applies an operator to its whole table, with production
parameters; and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Words of a text, A-Z lower-cased; shingles of three, joined by a space, which no word has.
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+')"
SQL["op2_ngram_jaccard_join"] = (
    f"WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents), "
    "s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w), "
    "sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), "
    "linked AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))), "
    "reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a) "
    "SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id, (SELECT count(*) FROM linked WHERE a = doc_id) AS n_links FROM s"
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


@query
def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lectern.llm.bpe import bpe_round_trip

    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lectern.llm.common import shared_dir
    from lectern.llm.token_files import read_tokens, write_tokens

    at = shared_dir(spark)
    manifest = write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), at)
    return read_tokens(manifest, at, with_ids=False)


@query
def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.flac import stored_digests

    return stored_digests(_table(spark, sf_dir, "documents"))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).docs


@query
def op4_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


@query
def op10_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.vector_forest import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.html_crf import extract

    return extract(_table(spark, sf_dir, "pages"))


@query
def op8_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.maxent_lm import score, train

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs, train(docs.where(~held_out)), held_out=held_out)


@query
def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.cotraining import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


@query
def op12_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.schema_rewrite import rewrite_clients

    return rewrite_clients(_table(spark, sf_dir, "clients"))


@query
def op13_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.kd_clusters import kd_means

    return kd_means(_table(spark, sf_dir, "embeddings"))


def _rounds(rounds: int = 10) -> str:
    """SQL of the clustering: a vector is rows (vec_id, i, v); each round is a step of its own."""
    near = "{0} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT x.vec_id, c.cluster, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {1} c USING (i) GROUP BY ALL) GROUP BY vec_id)"
    steps = [
        "kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64)",
        "x AS MATERIALIZED (SELECT vec_id, i, CAST(floor(1024 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v FROM kept, range(1, 65) r(i))",
        "first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < 8)",
        "c0 AS MATERIALIZED (SELECT cluster, i, v FROM first JOIN x USING (vec_id))",
    ]
    for r in range(rounds):
        steps.append(near.format(f"a{r}", f"c{r}"))
        mean = f"SELECT a.cluster, x.i, (sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM x JOIN a{r} a USING (vec_id) GROUP BY ALL"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.i, CAST(coalesce(m.m, c.v) AS BIGINT) AS v FROM c{r} c LEFT JOIN ({mean}) m USING (cluster, i))")
    steps.append(near.format("a", f"c{rounds}"))
    steps.append(f"s AS (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM a JOIN s USING (cluster)"
    )


SQL["op13_kd_clusters"] = _rounds()
