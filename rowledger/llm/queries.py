"""The queries of this subpackage, over the whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, embedding_join, image_copies, license_scan, lm_scoring, mixing, ngram_join, packing, token_alignment, token_counts, token_files, toxicity, warc, whitening


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels, categories = toxicity.graded(read(spark, sf_dir, "labels"))
    chain = toxicity.train(docs, labels, categories)
    limit = next(x.threshold for x in chain if x.name == "toxic")
    return toxicity.score(docs, chain).withColumn("toxic", F.col("p_toxic") >= limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), (512,), with_table=True)
    return token_counts.within_budget(counts, 512)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), 1)
    return token_files.checksums(token_files.read(spark, path))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_copies.copies(image_copies.page_images(read(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(read(spark, sf_dir, "documents"))


def op6_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.linked(read(spark, sf_dir, "embeddings"), 0.93)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"), 85, 100, 4)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, 1024, keep=700_000)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"), 16)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), groups="sha256")
    return token_alignment.with_counts(found).withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(read(spark, sf_dir, "pages"), path)
    # without payloads, a small table; both sides of the join read it
    found = warc.resolved(common.table(warc.payloads(warc.read(spark, path), with_payload=False), "payloads"))
    return found.select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to_id").cast("long").alias("refers_to"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_token_files, op4_image_copies, op5_lm_scoring, op6_embedding_join, op7_ngram_join, op8_license_scan, op9_mixing, op10_packing, op11_whitening, op12_token_alignment, op13_warc)}
    return found


#: The mix in SQL: sources, levels, whole copies, Pareto ranks and cut.
_MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u FROM documents),
m AS (SELECT *, length(ltrim(bin(size), '0')) + CAST(size = 0 AS INT) AS x FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM s),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(source_size * CAST(3 AS DOUBLE)) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY source_size * CAST(3 AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(source_size * CAST(3 AS DOUBLE), max(level) OVER () * w) AS target FROM l),
c AS (SELECT source, x, CAST(sum(size) AS DOUBLE) AS words FROM m GROUP BY source, x),
e AS (SELECT c.*, t.source_size, t.target, sum(x * words) OVER (PARTITION BY c.source) - coalesce(sum(x * words) OVER b, 0) AS open, t.target - coalesce(sum(words * CAST(3 AS DOUBLE)) OVER b, 0) AS due_words
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW b AS (PARTITION BY c.source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, least(CAST(3 AS DOUBLE), coalesce(max(CASE WHEN open > 0 THEN due_words / open END) OVER (PARTITION BY source), 0) * x) AS due FROM e),
g AS (SELECT *, floor(due) AS whole, due - floor(due) AS p, target - sum(floor(due) * words) OVER (PARTITION BY source) AS rest FROM f),
r AS (SELECT m.doc_id, m.size, g.*, (u / (1 - u)) / (p / (1 - p)) AS pareto FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source AND m.x = g.x),
o AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY p > 0 DESC, pareto, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN p > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o
"""


#: All pairs of a label, and what they reach.
_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM p WHERE p.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""


#: Pages of equal payloads: the smallest id is a response. Five hexadecimal signs are four of base32.
_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_join": _EMBEDDINGS, "op9_mixing": _MIX, "op13_warc": _WARC}
