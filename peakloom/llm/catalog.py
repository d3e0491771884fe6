"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import (
    bpe, decontaminate, mixing, pii, quality, ranked_search, sharding, simhash, token_files, topk, toxicity,
    url_rules, whitening,
)
from peakloom.llm.common import id_remainder
from peakloom.session import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SITE_RULES = (
    url_rules.site_rule("com", "/", "allow"),
    url_rules.site_rule("example.com", "/en/", "block"),
    url_rules.site_rule("www.example.com", "/en/", "allow"),
    url_rules.site_rule("net", "/es/", "block"),
    url_rules.site_rule("net", "/fr/", "block"),
)
#: The pattern list that decides where no site rule fits.
PATTERNS = (
    url_rules.UrlRule("cheap-pills", "block", "cheap-pills"),
    url_rules.UrlRule("/casino/", "block", "/casino/"),
    url_rules.UrlRule("||casino.", "block", "||casino."),
    url_rules.UrlRule("/login/*/reset|", "block", "/login/*/reset|"),
)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", toxicity.toxicity_score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


URL_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE
    WHEN contains(host || path, 'cheap-pills') THEN 'cheap-pills'
    WHEN regexp_matches(host || path, '/login/.*/reset$') THEN '/login/*/reset|'
    WHEN contains(host || path, '/casino/') THEN '/casino/'
    WHEN regexp_matches(host, '(^|\\.)casino\\.') THEN '||casino.' END AS fitted
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR fitted IS NOT NULL THEN 'block'
            ELSE 'allow' END AS verdict,
       coalesce(rule, fitted) AS pattern
FROM ruled
"""


@query("op2_url_rules", URL_SQL)
def url_verdicts(spark, sf_dir):
    rules = url_rules.rule_table(spark, [*SITE_RULES, *PATTERNS])
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


@query("op3_token_files")
def token_file_rows(spark, sf_dir):
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )
    rows = token_files.read_token_files(spark, folder).select(
        "doc_id", "start", token_files.payload_digest(F.col("payload")).alias("read")
    )
    return rows.select("doc_id", "start", "read.n_tokens", "read.ids_crc32")


TOP_K_SQL = """
WITH ints AS (
  SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op4_exact_top_k", TOP_K_SQL)
def exact_top_k(spark, sf_dir):
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), vector="embedding")
    return topk.exact_top_k(vectors, F.col("vec_id") % 20 == 0, 20)


@query("op5_byte_shards")
def byte_shards(spark, sf_dir):
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


CONTAMINATION_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, row_number() OVER () AS rid,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT rid, n, i, w[i : i + n - 1] AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
hits AS (SELECT rid, i, places.n, item_id FROM places JOIN windows ON places.n = windows.n AND places.win = windows.win),
marked AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
named AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)
"""


@query("op6_decontaminate", CONTAMINATION_SQL)
def benchmark_overlap(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op7_pii")
def personal_data(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", pii.pii_spans(F.col("text")).alias("pii"))
    base = pii.span_text(F.col("pii"), pii.BASE_KINDS)
    return found.select(
        "doc_id", *[pii.count_kind(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans"),
    )


@query("op8_quality")
def quality_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", quality.quality_score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op9_word_bpe")
def word_bpe(spark, sf_dir):
    return with_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), False)


def with_digests(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """`text` replaced by its token IDs (if kept), their number, and the digests of the IDs and of what they decode to."""
    found = ["ids"] * keep_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c != "text"]
    coded = docs.select(*kept, bpe.bpe_coded(F.col("text"), path, keep_ids).alias("_coded"))
    return coded.select(*kept, *[f"_coded.{c}" for c in found])


@query("op10_simhash")
def simhash_groups(spark, sf_dir):
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


SEARCH_SQL = r"""
WITH item AS (
  SELECT row_number() OVER () AS row, item_id, w FROM (
    SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, text FROM benchmark)),
asked AS (SELECT row, item_id, term, count(*) AS repeats FROM (SELECT row, item_id, unnest(w) AS term FROM item) GROUP BY ALL),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc),
held AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
sums AS (
  SELECT row, item_id, rid, CAST(sum(repeats * weighed.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(doc.w) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN held USING (term) JOIN doc USING (rid), totals
  GROUP BY row, item_id, rid),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id) AS rank
  FROM sums JOIN (SELECT rid, doc_id FROM doc) USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_ranked_search", SEARCH_SQL)
def benchmark_search(spark, sf_dir):
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@query("op12_whitening")
def whitened_embeddings(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


MIX_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM doc GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * s AS cap FROM src),
total AS (SELECT CAST(coalesce(sum(s), 0) AS BIGINT) AS t FROM src),
filled AS (
  SELECT *, t - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM weighed, total),
level AS (SELECT left_over, w_from FROM filled WHERE cap * w_from > w * left_over ORDER BY cap / w, rank LIMIT 1),
aimed AS (
  SELECT weighed.*, CASE WHEN level.w_from IS NULL OR cap * level.w_from <= w * level.left_over THEN CAST(cap AS DOUBLE)
                         ELSE CAST(level.left_over AS DOUBLE) * w / CAST(level.w_from AS DOUBLE) END AS target,
         greatest(32, CAST(ceil(t / 1073741824) AS BIGINT)) AS length
  FROM weighed CROSS JOIN total LEFT JOIN level ON TRUE),
cut AS (
  SELECT *, CASE WHEN s > 0 THEN greatest(1, CAST(floor(s / CAST(length AS DOUBLE) + 0.5) AS BIGINT)) ELSE 0 END AS blocks FROM aimed),
voting AS (SELECT *, CASE WHEN s > 0 THEN target * blocks / s ELSE 0 END AS votes FROM cut),
house AS (SELECT (CAST(sum(floor(votes * 1024)) AS BIGINT) + 512) // 1024 AS seats FROM voting),
bids AS (SELECT rank, votes / (2 * i + 1) AS bid FROM (SELECT rank, votes, unnest(range(0, 3 * blocks)) AS i FROM voting)),
won AS (
  SELECT rank, count(*) AS quota FROM (SELECT rank, row_number() OVER (ORDER BY bid DESC, rank) AS n FROM bids), house
  WHERE n <= seats GROUP BY rank),
plan AS (
  SELECT voting.*, coalesce(quota, 0) AS quota, CASE WHEN blocks > 0 THEN 2147483659 % blocks END AS factor,
         CASE WHEN blocks > 0 THEN CAST('0x' || substr(md5('42:' || rank), 1, 8) AS BIGINT) % blocks END AS shift
  FROM voting LEFT JOIN won USING (rank)),
laid AS (
  SELECT rid, doc_id, size, plan.*, CAST(coalesce(sum(size) OVER (PARTITION BY doc.source ORDER BY place, size, rid
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
  FROM doc JOIN plan ON doc.source IS NOT DISTINCT FROM plan.source),
edges AS (SELECT *, first + size AS past, s // greatest(blocks, 1) AS short, s % greatest(blocks, 1) AS longer FROM laid),
reach AS (
  SELECT *, CASE WHEN first < longer * (short + 1) THEN first // (short + 1)
                 ELSE longer + (first - longer * (short + 1)) // greatest(short, 1) END AS a,
            CASE WHEN past - 1 < longer * (short + 1) THEN (past - 1) // (short + 1)
                 ELSE longer + (past - 1 - longer * (short + 1)) // greatest(short, 1) END AS b
  FROM edges WHERE size > 0),
pieces AS (SELECT *, (block * factor + shift) % blocks AS spot FROM (SELECT *, unnest(range(a, b + 1)) AS block FROM reach)),
summed AS (
  SELECT rid, sum(CASE WHEN quota > spot THEN (quota - spot + blocks - 1) // blocks ELSE 0 END
                  * (least(past, (block + 1) * short + least(block + 1, longer)) - greatest(first, block * short + least(block, longer)))) AS taken
  FROM pieces GROUP BY rid)
SELECT doc_id, size, s AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM laid LEFT JOIN summed USING (rid)
"""


@query("op13_source_mixture", MIX_SQL)
def weighted_mixture(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("by_shard")
