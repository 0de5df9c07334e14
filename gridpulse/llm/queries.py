"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from gridpulse.llm import (
    alignment,
    bpe_codec,
    fingerprints,
    language_id,
    licences,
    mixing,
    near_dedup,
    nearest,
    packing,
    quality,
    sharding,
    spelling,
    substring_dedup,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def part_of(parts: int):
    """crc32 of the doc_id as text, modulo ``parts``; a null doc_id counts as empty."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text) % parts


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), words=2, percent=80)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(documents(spark, sf_dir), window=50)


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: folders of 16 documents in folders of 256; the first document of
    a folder is its README. Rows without a doc_id are named by their text in a folder of
    their own; those of one text are one file."""
    outer, inner = F.expr("doc_id div 256"), F.expr("doc_id div 16")
    path = (
        F.when(F.col("doc_id") % 256 == 0, F.concat_ws("/", outer, F.lit("README.md")))
        .when(F.col("doc_id") % 16 == 0, F.concat_ws("/", outer, inner, F.lit("README.md")))
        .when(F.col("doc_id").isNull(), F.concat(F.lit("unnamed/"), F.sha2(F.coalesce("text", F.lit("")), 256)))
        .otherwise(F.concat_ws("/", outer, inner, F.concat("doc_id", F.lit(".txt"))))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(documents(spark, sf_dir))
    return licences.licences(files.select("path", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = quality.training_rows(docs, labels(spark, sf_dir), part_of(4) != 2)
    scored = quality.scored(docs, quality.fit(rows), threshold=0.7)
    return scored.select("doc_id", (part_of(4) == 2).alias("held_out"), "score", "predicted")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, sf_dir))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.nearest(vectors, "vec_id", "embedding", "id % 50 = 0", k=5)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(language_id.training_rows(docs, part_of(3) != 1))
    found = language_id.identified(docs, model)
    return found.select(
        "doc_id", (part_of(3) == 1).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True
    )
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.interleaved_shards(documents(spark, sf_dir), shards=24)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.aligned(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.scheduled(documents(spark, sf_dir)).drop("positions")
    return mixing.in_training_order(mix)


LLM_QUERIES = {
    "pipeline": pipeline,
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_fingerprints": op5_fingerprints,
    "op6_language_id": op6_language_id,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_mix": op13_source_mix,
}

LLM_ORACLES = {
    "op8_sharding": r"""
WITH steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)::BIGINT[]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(b))),
sized AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum,
    md5('8:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
summed AS (
  SELECT doc_id, source, size, stratum, key,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(bytes, lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
  FROM sized, steps),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, size, text_crc32) - 1)::DOUBLE
    / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS place
  FROM summed),
cut AS (
  SELECT *, (row_number() OVER (ORDER BY place, stratum, key, doc_id, size, text_crc32) - 1) * 24
    // count(*) OVER () AS shard
  FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, stratum, key, doc_id, size, text_crc32) - 1 AS slot,
  NULL::INT AS grown_shard, source
FROM cut
""",
    "op1_substring_dedup": r"""
WITH tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda t: t <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM tokens WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS home FROM windows GROUP BY h),
hits AS (SELECT doc_id, list(i) AS s FROM windows JOIN least USING (h) WHERE home < doc_id GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM (SELECT doc_id, unnest(s) AS i FROM hits)),
gone_of AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)),
      lambda p: w[p]) END, ' ')) AS kept_sha256
FROM tokens t LEFT JOIN gone_of g ON g.doc_id = t.doc_id
""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda t: t <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2
      THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
      WHEN len(w) = 1 THEN w ELSE [] END) AS s
  FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT b, root FROM reach JOIN ways ON a = node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
  d.doc_id = component_id AS kept
FROM documents d JOIN least ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)::BIGINT[]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(b))),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'),
      lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
  FROM counted, steps),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (
  SELECT DISTINCT word, n, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
near AS (
  SELECT a AS word, count(*) AS n_near, min({'less': -w.n, 'word': b}) AS first
  FROM pairs JOIN words w ON w.word = b GROUP BY a),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN -first.less >= 5 * w.n THEN first.word END AS form,
    CASE WHEN -first.less >= 5 * w.n THEN -first.less END AS form_n
  FROM words w LEFT JOIN near ON near.word = w.word),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ends ON ends.word = f.word
""",
    "op13_source_mix": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('13:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::HUGEINT AS s FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, 3 * s AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS tier
  FROM totals),
lined AS (SELECT *, CASE tier WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM weighed),
-- Sources fill up in the order of cap / weight; 10 / w is whole.
filled AS (
  SELECT *, (SELECT sum(s) FROM totals)
      - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM lined WINDOW o AS (ORDER BY cap * (10 // w), source NULLS LAST)),
level AS (
  SELECT rest, share FROM filled WHERE cap * share >= w * rest
  ORDER BY cap * (10 // w), source NULLS LAST LIMIT 1),
aims AS (
  SELECT source, s::BIGINT AS source_size, tier,
    CASE WHEN cap * share < w * rest THEN cap::DOUBLE ELSE w * rest::DOUBLE / share::DOUBLE END AS target
  FROM lined, level),
placed AS (
  SELECT z.*, source_size, tier, target, coalesce(sum(size) OVER (PARTITION BY z.source
    ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized z JOIN aims a ON a.source IS NOT DISTINCT FROM z.source),
reading AS (
  SELECT *, list_transform(range(3), lambda r:
      greatest(least(floor(target + 0.5)::BIGINT - start - source_size * r, size), 0)) AS given,
    start / nullif(target, 0) AS q
  FROM placed)
SELECT doc_id, source, size, source_size, target, list_sum(given)::BIGINT AS taken,
  len(list_filter(given, lambda n: n > 0))::INT AS reads,
  CASE WHEN given[1] = 0 THEN NULL
    WHEN tier = 0 THEN q * 2 / (sqrt(2.25 + q * -2) + 1.5)
    WHEN tier = 1 THEN q * 2 / 2
    WHEN q >= 0.25 THEN (q - 0.25) * 2 / (sqrt(0.5625 + (q - 0.25) * 6) + 0.75) + 0.5
    ELSE q * 2 / (sqrt(0.0625 + q * 2) + 0.25) END AS position
FROM reading
""",
}
