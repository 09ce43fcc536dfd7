"""What SQL can say of the corpus operators: parts of their results as queries of their own, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.llm import jaccard, lm, mixing, pii, quality, secrets, sharding, urls
from terrakern.llm.common import UPPER, WORD, table

_LOWER = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"
_TEXT = "COALESCE(text, '')"

URLS_BY_RULE = f"""SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM
 (SELECT page_id, {_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, COALESCE(url, '') AS url FROM pages))"""


def urls_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page."""
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule")


_ASSIGN = secrets.ASSIGN.replace("'", "''")
SECRET_COUNTS = f"""SELECT doc_id, len(list_filter(regexp_extract_all({_TEXT}, '{_ASSIGN}', 2), lambda x: len(x) >= 8)) AS n_assign, len(list_filter(regexp_extract_all({_TEXT}, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16)) AS n_access,
 len(list_filter(regexp_extract_all({_TEXT}, '[0-9a-f]+'), lambda x: len(x) >= 32)) AS n_hex FROM documents"""


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of every document by kind."""
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


_WORDS = f"len(regexp_extract_all({_TEXT}, '{WORD}'))"
MIX_TARGETS = f"""WITH d AS (SELECT source, SUM({_WORDS}) AS size FROM documents GROUP BY source), n AS (SELECT *, ([5.0, 2.0, 1.0])[CAST((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w FROM d),
 l AS (SELECT *, 2.0 * size AS cap, 2.0 * size / w AS level FROM n), r AS (SELECT *, COALESCE(SUM(cap) OVER before, 0) AS capped, SUM(w) OVER () - COALESCE(SUM(w) OVER before, 0) AS open, SUM(size) OVER () * 1.5 AS budget
 FROM l WINDOW before AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), t AS (SELECT *, (budget - capped) / open AS try FROM r), f AS (SELECT ARG_MIN(try, level) AS reached FROM t WHERE try <= level)
 SELECT COALESCE(source, '(none)') AS source, CAST(size AS BIGINT) AS source_size, ROUND(CASE WHEN reached IS NULL THEN cap ELSE LEAST(cap, w * reached) END, 4) AS target FROM t, f"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target of every source, as the mix states them with its documents."""
    rows = mixing.mix(table(spark, sf_dir, "documents"), carry=["source"])
    return rows.select(F.coalesce("source", F.lit("(none)")).alias("source"), "source_size", F.round("target", 4).alias("target")).distinct()


def _jump(shards: int) -> str:
    two = "18446744073709551616::HUGEINT"
    return f"""w{shards} AS (SELECT k, s, -1::BIGINT AS b, 0::BIGINT AS j FROM keys UNION ALL SELECT k, (s * 2862933555777941757 + 1) % {two}, j,
 CAST(FLOOR((j + 1) * (2147483648.0::DOUBLE / CAST((((s * 2862933555777941757 + 1) % {two}) // 8589934592) + 1 AS DOUBLE))) AS BIGINT) FROM w{shards} WHERE j < {shards})"""


SHARDS_BY_KEY = f"""WITH RECURSIVE keys AS (SELECT DISTINCT doc_id AS k, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END AS s FROM documents), {_jump(8)}, {_jump(9)}
 SELECT doc_id, strlen({_TEXT}) + 1 AS size, a.shard, b.shard AS grown_shard FROM documents JOIN (SELECT k, CAST(MAX(b) AS INTEGER) AS shard FROM w8 GROUP BY k) a ON a.k = doc_id JOIN (SELECT k, CAST(MAX(b) AS INTEGER) AS shard FROM w9 GROUP BY k) b ON b.k = doc_id"""


def shards_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and both shards of every document."""
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "shard", "grown_shard")


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(len({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({_DIGITS}, CAST(len({_DIGITS}) - i AS BIGINT), 1) AS INTEGER) ELSE (CAST(substr({_DIGITS}, CAST(len({_DIGITS}) - i AS BIGINT), 1) AS INTEGER) * 2) - CASE WHEN CAST(substr({_DIGITS}, CAST(len({_DIGITS}) - i AS BIGINT), 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
PII_COUNTS = rf"""SELECT doc_id, len(regexp_extract_all({_TEXT}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
 len(list_filter(regexp_extract_all({_TEXT}, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: COALESCE(TRY_CAST(p AS BIGINT) <= 255, FALSE))))) AS n_ip,
 len(list_filter(regexp_extract_all({_TEXT}, '[0-9]([\x20-]?[0-9])+'), lambda x: len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN})) AS n_card,
 len(list_filter(regexp_extract_all({_TEXT}, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone FROM documents"""


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base personal data of every document by kind."""
    return pii.detect(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


SHINGLE_COUNTS = f"""SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS n_shingles
 FROM (SELECT doc_id, regexp_extract_all({_LOWER.format(_TEXT)}, '{WORD}') AS w FROM documents)"""


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of shingles."""
    return jaccard.sizes(table(spark, sf_dir, "documents"))


#: CTEs crc (of each id written as text) in SQL, by the published table of 256.
_CRC = """bits AS (SELECT i AS n, i AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8), tab AS (SELECT n, v FROM bits WHERE k = 8),
 spell AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS t, 1 AS pos, 4294967295 AS c FROM documents UNION ALL SELECT doc_id, t, pos + 1, xor(c // 256, v) FROM spell JOIN tab ON n = xor(c % 256, ascii(substr(t, pos, 1))) WHERE pos <= len(t)),
 crc AS (SELECT doc_id AS crc_id, xor(c, 4294967295) AS c FROM spell WHERE pos = len(t) + 1)"""
FOLDS = f"WITH RECURSIVE {_CRC} SELECT doc_id, c % 3 = 1 AS of_quality, c % 7 = 2 AS of_language FROM documents JOIN crc ON crc_id = doc_id"


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the classifier and the language model hold out."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", quality.held_out(F.col("doc_id")).alias("of_quality"), (~lm.learning(F.col("doc_id"))).alias("of_language"))


BASE_SCORES = f"""WITH RECURSIVE {_CRC}, w AS (SELECT doc_id, c % 7 = 2 AS held, list_append(regexp_extract_all({_LOWER.format(_TEXT)}, '{WORD}'), ' ') AS words FROM documents JOIN crc ON crc_id = doc_id),
 k AS (SELECT word, COUNT(*) AS n FROM (SELECT UNNEST(words) AS word FROM w WHERE NOT held) GROUP BY word), a AS (SELECT SUM(n) AS n, COUNT(*) AS v FROM k)
 SELECT doc_id, held AS held_out, COUNT(*) AS n_tokens, COUNT(k.n) AS n_known, CAST(MAX(a.n) AS BIGINT) AS train_tokens, ROUND(SUM(log10((COALESCE(k.n, 0) + 1) / (a.n + a.v + 1))), 4) AS base_score
 FROM (SELECT doc_id, held, UNNEST(words) AS word FROM w) t LEFT JOIN k ON k.word = t.word, a GROUP BY doc_id, held"""


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word base of every document."""
    rows = lm.score(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LINKS = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
 SELECT a.vec_id, COUNT(b.vec_id) AS n_links FROM u a LEFT JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9 GROUP BY a.vec_id"""


def vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other vectors each vector is linked with."""
    from terrakern.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links")


_CHECKS = {
    urls_by_rule: URLS_BY_RULE, secret_counts: SECRET_COUNTS, mix_targets: MIX_TARGETS, shards_by_key: SHARDS_BY_KEY, pii_counts: PII_COUNTS, folds: FOLDS,
    vector_links: LINKS, shingle_counts: SHINGLE_COUNTS, base_scores: BASE_SCORES,
}
QUERIES = {f.__name__: f for f in _CHECKS}
ORACLE_SQL = {f.__name__: sql for f, sql in _CHECKS.items()}
