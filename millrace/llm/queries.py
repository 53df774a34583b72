"""The registered query of each operator, over whole tables, and DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mainpage, matroska, merkle, packing, pieces, secrets, simhash, spelling, token_count, toxicity, urlfilter, vectors
from millrace.runtime import table


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = matroska.media_columns(table(spark, sf_dir, "documents"))
    return media.select("doc_id", "n_bytes", matroska.digest(F.col("media")).alias("_d")).select("doc_id", "n_bytes", "_d.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.words_of(table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = values[:3] + [(F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)"), values[4]]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(docs, merkle.digest(values), F.when(touched, merkle.digest(tampered))).drop("siblings", "shape")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpage.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op4_pieces": op4_pieces,
    "op8_media_columns": op8_media_columns,
    "op2_toxicity": op2_toxicity,
    "op5_language_id": op5_language_id,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op3_token_counts": op3_token_counts,
    "op7_secret_scans": op7_secret_scans,
    "op9_url_filters": op9_url_filters,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_html_extraction": op13_html_extraction,
}

ORACLES = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.a = v.vec_id
""",
    "op9_url_filters": """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule, domain, prefix, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fit AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN verdict
            WHEN path LIKE '/%' AND host LIKE '%adult%' THEN 'block'
            WHEN path LIKE '/%' AND host LIKE '%casino%' THEN 'block'
            WHEN path LIKE '/%' AND host LIKE 'ads.%' THEN 'block'
            WHEN path LIKE '/%' AND host LIKE '%.ads.%' THEN 'block'
            WHEN path LIKE '/%/ads/%' THEN 'block'
            WHEN path LIKE '/%.exe' THEN 'block'
            ELSE 'allow' END AS verdict
FROM fit WHERE k = 1
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), per AS (
  SELECT doc_id, w, count(*) AS k FROM run GROUP BY doc_id, w
), hex AS (
  SELECT doc_id, w, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM per
), crc AS (
  SELECT w, k, 4294967295 - list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(0, length(x) // 2), lambda i: (strpos('0123456789ABCDEF', substr(x, (2 * i + 1)::INT, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, (2 * i + 2)::INT, 1)) - 1)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda v, step: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS h FROM hex
), vocab AS (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM crc)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM vocab)
), pair AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN vocab v ON c.rest = v.word
  UNION SELECT v.word, c.word FROM cut c JOIN vocab v ON c.rest = v.word
), near AS (
  SELECT a AS word, count(*) AS n_near, max(v.n) AS most FROM pair JOIN vocab v ON v.word = b GROUP BY a
), best AS (
  SELECT pair.a AS word, min(b) AS form FROM pair JOIN vocab v ON v.word = b JOIN near ON near.word = pair.a AND v.n = most GROUP BY pair.a
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN form END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n
  FROM vocab v LEFT JOIN near ON near.word = v.word LEFT JOIN best ON best.word = v.word
), walk(word, goal, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.goal WHERE f.form IS NOT NULL
), root AS (SELECT word, arg_max(goal, step) AS root FROM walk GROUP BY word)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN root ON root.word = forms.word
""",
    "op12_merkle_manifest": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
         (4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(doc_id::VARCHAR)), lambda k: ascii(substr(doc_id::VARCHAR, (k + 1)::INT, 1))::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 7 = 0 AS touched
  FROM documents
), s AS (
  SELECT doc_id, lang, i, touched, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')) AS own,
         list_transform([doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')) AS other
  FROM d
), leaf AS (
  SELECT doc_id, lang, i, sha256(array_to_string(own, '')) AS h, CASE WHEN touched THEN sha256(array_to_string(other, '')) ELSE sha256(array_to_string(own, '')) END AS seen FROM s
), node(lang, level, i, h, n) AS (
  SELECT lang, 0, i, h, count(*) OVER (PARTITION BY lang) FROM leaf
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(h || coalesce(lead(h) OVER (PARTITION BY lang ORDER BY i), '')), (n + 1) // 2
  FROM node WHERE n > 1 QUALIFY i % 2 = 0
), sub AS (
  SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM node WHERE n = 1
), over_(level, i, h, n) AS (
  SELECT 0, j, subroot, m FROM sub
  UNION ALL
  SELECT level + 1, i // 2, sha256(h || coalesce(lead(h) OVER (ORDER BY i), '')), (n + 1) // 2 FROM over_ WHERE n > 1 QUALIFY i % 2 = 0
), top AS (SELECT h AS root, level AS tall FROM over_ WHERE n = 1
), walk AS (
  SELECT doc_id, k, CASE WHEN k < height THEN (leaf.i >> k) % 2 ELSE (j >> (k - height)) % 2 END AS odd, coalesce(a.h, b.h, '') AS sib
  FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang CROSS JOIN top CROSS JOIN LATERAL (SELECT unnest(range(0, height + tall))::INT AS k) AS steps
  LEFT JOIN node a ON a.lang IS NOT DISTINCT FROM leaf.lang AND k < height AND a.level = k AND a.i = xor(leaf.i >> k, 1)
  LEFT JOIN over_ b ON k >= height AND b.level = k - height AND b.i = xor(j >> (k - height), 1)
), proof AS (
  SELECT doc_id, string_agg(sib, '' ORDER BY k) AS chain FROM walk GROUP BY doc_id
), folded(doc_id, k, h) AS (
  SELECT doc_id, 0, seen FROM leaf
  UNION ALL
  SELECT f.doc_id, f.k + 1, sha256(CASE WHEN odd = 1 THEN sib || h ELSE h || sib END) FROM folded f JOIN walk w ON w.doc_id = f.doc_id AND w.k = f.k
), last AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM folded GROUP BY doc_id)
SELECT leaf.doc_id, leaf.h AS leaf, subroot, root, sha256(coalesce(chain, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang CROSS JOIN top JOIN last ON last.doc_id = leaf.doc_id LEFT JOIN proof ON proof.doc_id = leaf.doc_id
""",
}
