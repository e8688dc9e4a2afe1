"""One query per corpus operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tidemark.llm import (
    centroids,
    embedding_dedup,
    exact_dedup,
    language_model,
    line_dedup,
    packing,
    quality,
    secrets,
    sentence_pieces,
    sharding,
    simhash,
    spelling,
    toxicity,
)
from tidemark.llm.common import filled, id_remainder, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 65,536 padded words in 32 length buckets."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_by_length(docs, packing.word_count("text"), spread_by=filled("text"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of each text, equal but for white space, and the row that stays."""
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), all_digests=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of each document, learned from nine tenths of them."""
    return language_model.score_documents(table(spark, sf_dir, "documents"), id_remainder("doc_id", 10) == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages without the lines that are on more than a quarter of their site's pages."""
    return line_dedup.drop_site_boilerplate(table(spark, sf_dir, "pages"), line_dedup.host_of("url"), line_dedup.page_text("html"))


OP4_SQL = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) AS host,
         list_filter(list_transform(string_split(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '[\x20\x09-\x0D]+', ' ', 'g'),
             '{line_dedup.UNSEEN}', ' ', 'g'), '{line_dedup.BLOCKS}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
           lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS host_pages FROM p WHERE host <> '' GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host <> '') GROUP BY host, line),
b AS (SELECT c.host, list(line) AS boilerplate FROM c JOIN t USING (host) WHERE n >= 3 AND n > 0.25 * host_pages GROUP BY c.host),
k AS (
  SELECT page_id, p.host, len(lines)::INT AS n_lines,
         CASE WHEN boilerplate IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(boilerplate, x)) END AS kept
  FROM p LEFT JOIN b USING (host))
SELECT page_id, host, n_lines, (n_lines - len(kept))::INT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from four fifths of the labels."""
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder("doc_id", 5) == 0
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from two thirds of the labels."""
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder("doc_id", 3) == 1
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document as spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_secrets(docs)
    counts = [secrets.span_count(F.col("base_secrets"), kind).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.span_text(F.col("base_secrets")), 256).alias("base_sha256"), secrets.span_text(F.col("secrets")).alias("spans")
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two or fewer differing bits."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the piece ids of each document and of the text they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.encode_texts(table(spark, sf_dir, "documents"), path, digests=True)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label that link at a cosine of 0.98 or more."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), group=F.col("label"))


OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM e LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in 40 shards by a uniform shuffle; only their sizes and checksums move."""
    docs = table(spark, sf_dir, "documents")
    size = (sharding.utf8_size(F.col("text")) + 16).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(filled("text")).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(rows, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors in 16 clusters after three rounds."""
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(clusters: int, dims: int, scale: int, rounds: int) -> str:
    """Rounds unrolled; centroids are lists, distances are taken to all of them."""
    steps = [
        f"""WITH k AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
f AS (SELECT q, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS cluster FROM k),
c0 AS (SELECT cluster, q AS c FROM f WHERE cluster < {clusters})"""
    ]
    for t in range(rounds + 1):
        squared = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (k.q[i] - c.c[i]) * (k.q[i] - c.c[i])))"
        steps.append(
            f"""a{t} AS (
  SELECT row_id, vec_id, q, cluster, distance::BIGINT AS distance FROM (
    SELECT k.*, cluster, {squared} AS distance FROM k CROSS JOIN c{t} AS c)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, cluster) = 1)"""
        )
        if t < rounds:
            steps.append(
                f"""m{t} AS (
  SELECT cluster, list(floor(total / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(x)::DOUBLE AS total, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range({dims})) AS i FROM a{t}) GROUP BY cluster, i)
  GROUP BY cluster),
c{t + 1} AS (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{t} AS c LEFT JOIN m{t} AS m USING (cluster))"""
            )
    steps.append(f"""e AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)""")
    last = f"""SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance) FROM a{rounds})::BIGINT AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN e USING (cluster) JOIN c{rounds} AS c USING (cluster)"""
    return ",\n".join(steps) + "\n" + last


OP12_SQL = _op12_sql(16, 64, 64, 3)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents with their spelling variants."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


# CRC-32 byte by byte, with the usual table made from its polynomial 0xEDB88320.
OP13_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc
  FROM range(256) r(b)),
o AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '{spelling.LETTERS}')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM o WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]))) AS h
  FROM g, t),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT DISTINCT a.word AS word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS form, max(near_n) AS form_n FROM p GROUP BY word),
v AS (
  SELECT word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM w LEFT JOIN b USING (word)),
r(word, root) AS (SELECT word, word FROM v WHERE form IS NULL UNION ALL SELECT v.word, r.root FROM v JOIN r ON v.form = r.word)
SELECT v.word, form, root, n, n_near, form_n FROM v JOIN r USING (word)
"""

QUERIES = {
    "op1_packing": (op1_packing, None),
    "op2_exact_dedup": (op2_exact_dedup, OP2_SQL),
    "op3_language_model": (op3_language_model, None),
    "op4_line_dedup": (op4_line_dedup, OP4_SQL),
    "op5_toxicity": (op5_toxicity, None),
    "op6_quality": (op6_quality, None),
    "op7_secret_scan": (op7_secret_scan, None),
    "op8_sentence_pieces": (op8_sentence_pieces, None),
    "op9_simhash": (op9_simhash, None),
    "op10_embedding_dedup": (op10_embedding_dedup, OP10_SQL),
    "op11_sharding": (op11_sharding, None),
    "op12_centroids": (op12_centroids, OP12_SQL),
    "op13_spelling": (op13_spelling, OP13_SQL),
}
