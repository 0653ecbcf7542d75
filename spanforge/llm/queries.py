"""The queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.bpe import round_trip_digests
from spanforge.llm.common import fresh_path
from spanforge.llm.embedding_dedup import near_vectors
from spanforge.llm.hmm import score_documents
from spanforge.llm.line_dedup import dedup_lines
from spanforge.llm.mixing import corpus_mix, mix_counts
from spanforge.llm.secrets import secret_digests
from spanforge.llm.simhash import fingerprint_hex, near_groups
from spanforge.llm.spelling import group_spellings
from spanforge.llm.toxicity import ToxicityChain, chain_labels
from spanforge.llm.url_filter import Rule, filter_urls
from spanforge.llm.vectors import top_k
from spanforge.llm.warc import archive_round_trip
from spanforge.llm.whitening import whitened_rows

URL_RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List: every address that occurs with a ``utm_source`` parameter."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, URL_RULES, F.coalesce(F.col("url").contains("utm_source="), F.lit(False)))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """vocabulary: path of a rank file; pattern: what splits text. The installed public ones unless given."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = chain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ToxicityChain().fit(docs, labels).transform(docs).drop("text")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), corpus_mix())


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_top_k": op1_top_k, "op2_line_dedup": op2_line_dedup, "op3_bpe": op3_bpe, "op4_warc": op4_warc, "op5_toxicity": op5_toxicity, "op6_embedding_dedup": op6_embedding_dedup, "op7_mixing": op7_mixing, "op8_hmm": op8_hmm, "op9_simhash": op9_simhash, "op10_url_filter": op10_url_filter, "op11_secrets": op11_secrets, "op12_whitening": op12_whitening, "op13_spelling": op13_spelling}

ORACLES = {
    "op1_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op2_line_dedup": """
WITH d AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d
), r AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE top <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id""",
    "op7_mixing": r"""
WITH num AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(try_cast(regexp_extract(source, '[0-9]+', 0) AS INT), -1) AS number,
    trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM documents
), d AS (
  SELECT doc_id, CASE WHEN number = 0 THEN 'web' WHEN number BETWEEN 1 AND 9 THEN 'reference' WHEN number >= 10 THEN 'forum' ELSE 'other' END AS domain, lang, source,
    CASE WHEN bare = '' THEN 0 ELSE len(regexp_split_to_array(bare, '[\x20\x09-\x0D]+')) END AS n_tokens FROM num
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY ALL
), a0 AS (
  SELECT least(sum(tokens), sum(tokens) * 2)::HUGEINT AS amount FROM leaf
), n1 AS (
  SELECT n.*, a.amount FROM (SELECT domain, sum(tokens)::HUGEINT * 2 AS cap, (CASE domain WHEN 'web' THEN 8 WHEN 'reference' THEN 6 WHEN 'forum' THEN 6 ELSE 1 END)::HUGEINT AS w FROM leaf GROUP BY domain) n JOIN a0 a ON true
), f1 AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS filled,
    (sum(w) OVER (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS opened FROM n1
), a1 AS (
  SELECT domain, (CASE WHEN is_full THEN cap ELSE ((amount - full_cap) * w) // nullif(open_w, 0) END)::HUGEINT AS amount FROM (
    SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)::HUGEINT AS full_cap, coalesce(sum(w) FILTER (WHERE NOT is_full) OVER (), 0)::HUGEINT AS open_w
    FROM (SELECT *, cap * opened <= (amount - filled) * w AS is_full FROM f1))
), n2 AS (
  SELECT n.*, a.amount FROM (SELECT domain, lang, sum(tokens)::HUGEINT * 2 AS cap, (CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 15 WHEN 'fr' THEN 14 WHEN 'es' THEN 11 ELSE 1 END)::HUGEINT AS w FROM leaf GROUP BY domain, lang) n JOIN a1 a ON n.domain = a.domain
), f2 AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS filled,
    (sum(w) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS opened FROM n2
), a2 AS (
  SELECT domain, lang, (CASE WHEN is_full THEN cap ELSE ((amount - full_cap) * w) // nullif(open_w, 0) END)::HUGEINT AS amount FROM (
    SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER (PARTITION BY domain ), 0)::HUGEINT AS full_cap, coalesce(sum(w) FILTER (WHERE NOT is_full) OVER (PARTITION BY domain ), 0)::HUGEINT AS open_w
    FROM (SELECT *, cap * opened <= (amount - filled) * w AS is_full FROM f2))
), n3 AS (
  SELECT n.*, a.amount FROM (SELECT domain, lang, source, sum(tokens)::HUGEINT * 2 AS cap, (1)::HUGEINT AS w FROM leaf GROUP BY domain, lang, source) n JOIN a2 a ON n.domain = a.domain AND n.lang = a.lang
), f3 AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS filled,
    (sum(w) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS opened FROM n3
), a3 AS (
  SELECT domain, lang, source, (CASE WHEN is_full THEN cap ELSE ((amount - full_cap) * w) // nullif(open_w, 0) END)::HUGEINT AS amount FROM (
    SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER (PARTITION BY domain, lang ), 0)::HUGEINT AS full_cap, coalesce(sum(w) FILTER (WHERE NOT is_full) OVER (PARTITION BY domain, lang ), 0)::HUGEINT AS open_w
    FROM (SELECT *, cap * opened <= (amount - filled) * w AS is_full FROM f3))
), p AS (
  SELECT d.*, CASE WHEN tokens = 0 THEN 0 ELSE amount // tokens END AS epochs, CASE WHEN tokens = 0 THEN -1 ELSE amount % tokens END AS rest
  FROM d JOIN leaf USING (domain, lang, source) JOIN a3 USING (domain, lang, source)
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p
)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c""",
    "op10_url_filter": """
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, coalesce(contains(url, 'utm_source='), false) AS on_list
  FROM u
), l AS (
  SELECT *, bool_or(on_list) OVER (PARTITION BY host || path) AS listed,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM l""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS first_id,
    list_transform(range(0, 160, 5), lambda i: substr(list_aggregate(list_transform(string_split(hex, ''), lambda c:
      ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789ABCDEF', c)]), 'string_agg', ''), i::INT + 1, 5)) AS fives
  FROM p
)
SELECT page_id, payload_bytes, list_aggregate(list_transform(fives, lambda f: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(f, 1, 1)::INT + 8 * substr(f, 2, 1)::INT + 4 * substr(f, 3, 1)::INT + 2 * substr(f, 4, 1)::INT + substr(f, 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(first_id, page_id) AS refers_to, true AS intact
FROM d""",
    "op11_secrets": r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tbl FROM range(256) t(i)
), d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), kind AS (
  SELECT * FROM (VALUES (1, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (2, 'access', 'AKIA[A-Z0-9]+'), (3, 'hex', '[0-9a-f]+'), (4, 'github', 'gh[pousr]_[A-Za-z0-9]+'), (5, 'npm', 'npm_[A-Za-z0-9]+')) k(place, kind, pattern)
), parts AS (
  SELECT row, place, kind, pattern, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS between FROM d, kind WHERE kind <> 'hex' AND regexp_matches(text, pattern)
  UNION ALL SELECT row, place, kind, pattern, regexp_extract_all(text, '[0-9a-f]{32,}'), string_split_regex(text, '[0-9a-f]{32,}') FROM d, kind WHERE kind = 'hex' AND regexp_matches(text, '[0-9a-f]{32}')
), spot AS (
  SELECT *, found[i] AS m, (list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM parts)
), token AS (
  SELECT *, substr(m, strpos(m, '_') + 1) AS body FROM spot
), summed AS (
  SELECT *, CASE WHEN place > 3 AND length(body) = 36 THEN xor(list_reduce(list_transform(string_split(substr(body, 1, 30), ''), lambda x: unicode(x)::BIGINT), lambda c, b: xor(c >> 8, tbl[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) END AS sum FROM token, crc
), valid AS (
  SELECT row, place, kind || ':' || start || ':' || (start + length(m)) AS span, start FROM summed WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, pattern, 2)) >= 8 WHEN 'access' THEN length(m) >= 16 WHEN 'hex' THEN length(m) >= 32
    ELSE substr(body, 31) = list_aggregate(list_transform(range(5, -1, -1), lambda j: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', ((sum // (62 ** j)::BIGINT) % 62)::INT + 1, 1)), 'string_agg', '') END
), own AS (
  SELECT row, count(*) FILTER (WHERE place = 1) AS n_assign, count(*) FILTER (WHERE place = 2) AS n_access, count(*) FILTER (WHERE place = 3) AS n_hex,
    string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < 4) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM valid GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN own USING (row)""",
    "op13_spelling": r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tbl FROM range(256) t(i)
), run AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), each AS (
  SELECT doc, run, count(*) AS times FROM run WHERE length(run) >= 6 GROUP BY doc, run
), hashed AS (
  SELECT run, times, xor(list_reduce(flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)),
    lambda c, b: xor(c >> 8, tbl[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM each, crc
), word AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
), w AS (
  SELECT word, sum(times)::BIGINT AS n FROM word WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM w)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON cut.rest = w.word
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON cut.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(struct_pack(other, m), struct_pack(a := -m, b := other)) AS b FROM near GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM w LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS root FROM w UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.root = f.word WHERE f.form IS NOT NULL
), last AS (
  SELECT way.word, way.root FROM way JOIN f ON way.root = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n FROM f JOIN last USING (word)""",
}
