"""Registered queries of the engine's own operators, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as text_fn
from millrace.operators import dedup, generate, lanes, quality, ranks, sessions, votes
from millrace.runtime import table, written
from millrace.sinks import emit
from millrace.sources import jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Scored items from documents and labels: aggregate from the length, null where no label is known."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    known = table(spark, d, "labels").select("doc_id", "quality")
    score = F.when(F.col("quality").isNotNull(), (F.col("n_chars") % 97) / 96.0 * 0.5 + F.col("quality") * 0.5)
    return docs.join(known, "doc_id", "left").withColumn("score", score)


SCORES = "scores AS (SELECT d.doc_id, lang, n_chars, quality, CASE WHEN quality IS NOT NULL THEN (n_chars % 97) / 96.0 * 0.5 + quality * 0.5 END AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query()
def flagship_dedup(spark, d):
    """Exact and near-duplicate verdict of every document, in order of arrival."""
    return dedup.dedup(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "doc_id", "text")


@query()
def indexed_dedup(spark, d):
    """As `flagship_dedup`, in two batches: the later half of the ids probes and extends what the earlier half left in the index."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("id"))
    half = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    index = dedup.Index(spark)
    parts = [index.add(docs.where(own), "doc_id", "id", "text") for own in (F.col("doc_id") <= half, F.col("doc_id") > half)]
    return parts[0].unionByName(parts[1]).select("doc_id", "text", "kind", "cluster_key", F.col("kept_id").cast("long").alias("kept_id"))


@query("""
WITH f AS (SELECT sha256(coalesce(text, '')) AS h, min(doc_id) AS first FROM documents GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.doc_id <> first THEN 'exact' ELSE 'unique' END AS kind, substr(h, 1, 16) AS cluster_key,
       CASE WHEN d.doc_id <> first THEN first END AS kept_id
FROM documents d JOIN f ON h = sha256(coalesce(d.text, ''))""")
def dedup_exact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return dedup.exact(docs, "doc_id", F.sha2("text", 256), "doc_id").drop("text")


_NORMAL = r"sha256(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')))"


@query(f"""
WITH n AS (SELECT doc_id, {_NORMAL} AS h FROM documents), f AS (SELECT h, min(doc_id) AS first FROM n GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id <> first THEN 'exact' ELSE 'unique' END AS kind, substr(n.h, 1, 16) AS cluster_key, CASE WHEN doc_id <> first THEN first END AS kept_id FROM n JOIN f ON n.h = f.h""")
def dedup_exact_normalized(spark, d):
    """Exact verdict over normalised texts, as runs take it; `dedup_exact` is the one over raw texts that its SQL fixes."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(text_fn.normalized(F.coalesce("text", F.lit(""))), 256).alias("digest"))
    return dedup.exact(written(docs, "digests"), "doc_id", F.col("digest"), "doc_id").drop("digest")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT p.vec_id AS probe, k.vec_id AS kept, list_cosine_similarity(p.e, k.e) AS s FROM v p JOIN v k ON p.vec_id % 2 = 1 AND k.vec_id % 2 = 0)
SELECT probe, arg_max(kept, s) AS kept, round(max(s), 9) AS similarity FROM m WHERE s >= 0.3 GROUP BY probe""")
def semantic_probe(spark, d):
    """Nearest kept vector of each probe: odd ids against even ids."""
    v = table(spark, d, "embeddings")
    near = dedup.nearest_vector(v.where("vec_id % 2 = 1"), v.where("vec_id % 2 = 0"), "vec_id", "embedding", threshold=0.3)
    return near.withColumn("similarity", F.round("similarity", 9))


@query()
def semantic_dedup(spark, d):
    """Verdict of every vector against all kept earlier ones; `semantic_probe` only holds `nearest_vector` against SQL."""
    return dedup.semantic(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding").drop("embedding")


@query("""SELECT doc_id, substr(sha256(to_json({'text': text})::VARCHAR), 1, 16) AS record_id, length(text) AS n FROM documents""")
def record_ids(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text_fn.record_id(F.to_json(F.struct("text"))).alias("record_id"), F.length("text").cast("long").alias("n"))


@query("""
WITH c AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS wide_or_other,
  length(text) - length(regexp_replace(text, '[\\x{3000}-\\x{303F}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{2CEB0}-\\x{2EBEF}\\x{2EBF0}-\\x{2EE5F}\\x{30000}-\\x{3134F}\\x{31350}-\\x{323AF}]', '', 'g')) AS cjk FROM documents)
SELECT doc_id, ceil((n - wide_or_other) / 3.0 + cjk + (wide_or_other - cjk) / 2.0)::BIGINT AS tokens,
       ceil((n - wide_or_other) / 3.0 + cjk + (wide_or_other - cjk) / 2.0) <= 8192 - 4096 - greatest(256, ceil(8192 * 0.1)) AS fits FROM c""")
def token_estimates(spark, d):
    """Estimated tokens of each text, and whether it fits a declared window (the check before a call)."""
    out = table(spark, d, "documents").select("doc_id", text_fn.token_estimate(F.col("text")).alias("tokens"))
    return out.withColumn("fits", F.col("tokens") <= text_fn.input_budget(F.lit(8192), F.lit(4096)))


@query("""
SELECT w AS window_tokens, px, CASE WHEN w <= 0 THEN 0 ELSE w - 1024 - greatest(256, ceil(w * 0.1)) END::BIGINT AS input_budget,
  CASE WHEN w <= 0 THEN 0 ELSE w - greatest(256, ceil(w * 0.1)) END::BIGINT AS embed_budget,
  least(ceil(px / 28.0) ** 2, 1568)::BIGINT AS patches,
  (85 + 170 * ceil(least(768, least(px, 2048)) / 512.0) * ceil(least(px, 2048) / 512.0))::BIGINT AS tiles
FROM (SELECT (o_orderkey * 37) % 200000 AS w, 28 + (o_orderkey * 13) % 3000 AS px FROM orders)""")
def budgets(spark, d):
    """Budget arithmetic over a spread of windows and picture sizes."""
    rows = table(spark, d, "orders").select(((F.col("o_orderkey") * 37) % 200000).alias("window_tokens"), (28 + (F.col("o_orderkey") * 13) % 3000).alias("px"))
    w, px = F.col("window_tokens"), F.col("px")
    return rows.select(
        "window_tokens", "px",
        text_fn.input_budget(w, F.lit(1024)).cast("long").alias("input_budget"), text_fn.embed_budget(w).cast("long").alias("embed_budget"),
        text_fn.image_prior(F.lit("patch"), px).cast("long").alias("patches"), text_fn.image_prior(F.lit("tile"), px).cast("long").alias("tiles"),
    )


@query("""
WITH b AS (SELECT page_id, html, CASE WHEN html IS NULL OR trim(html) = '' THEN 'no_text' WHEN length(html) < 400 THEN 'too_short' END AS bad FROM pages),
k AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM b WHERE bad IS NULL)
SELECT page_id, n AS seq, ((n - 1) // 16 + 1)::BIGINT AS batch_no FROM k WHERE n <= 100""")
def valid_batches(spark, d):
    """The first 100 valid rows in input order, numbered and cut into batches; bad rows take no number."""
    pages = table(spark, d, "pages")
    bad = F.when(F.col("html").isNull() | (F.trim("html") == ""), "no_text").when(F.length("html") < 400, "too_short")
    good = jsonl.first_valid(pages.withColumn("bad", bad).where("bad is null").select("page_id"), ["page_id"], 100)
    return jsonl.batches(good, ["page_id"], 16)


@query("""SELECT page_id, row_number() OVER (ORDER BY page_id) AS seq, ((row_number() OVER (ORDER BY page_id) - 1) // 16 + 1)::BIGINT AS batch_no
FROM pages WHERE html IS NOT NULL AND trim(html) <> '' AND length(html) >= 400""")
def page_batches(spark, d):
    """Every valid row in input order, numbered and cut into batches."""
    good = table(spark, d, "pages").where(F.col("html").isNotNull() & (F.trim("html") != "") & (F.length("html") >= 400))
    return jsonl.batches(good.select("page_id"), ["page_id"], 16)


@query("""SELECT page_id FROM pages WHERE html IS NOT NULL AND trim(html) <> '' AND length(html) >= 400 ORDER BY page_id LIMIT 100""")
def first_pages(spark, d):
    """The first 100 valid rows in input order, the limit of a run alone."""
    good = table(spark, d, "pages").where(F.col("html").isNotNull() & (F.trim("html") != "") & (F.length("html") >= 400))
    return jsonl.first_valid(good.select("page_id"), ["page_id"], 100)


_KEY = "CASE event_id % 6 WHEN 0 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) WHEN 1 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) WHEN 2 THEN '-5' WHEN 3 THEN 'true' WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE '1e14' END"


@query(f"""
WITH k AS (SELECT event_id, {_KEY} AS raw FROM events), n AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS x FROM k)
SELECT event_id, raw, CASE WHEN x IS NOT NULL THEN CASE WHEN x < 0 OR x >= 1e14 THEN NULL WHEN x < 1e11 THEN x ELSE x / 1000.0 END
  WHEN raw LIKE '____-__-__T%' THEN epoch(TRY_CAST(raw AS TIMESTAMPTZ)) END AS order_key FROM n""")
def order_keys(spark, d):
    """Timestamps given as seconds, milliseconds, ISO strings and junk."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.floor(micros / 1000000).cast("string")).when(k == 1, F.floor(micros / 1000).cast("string")).when(k == 2, "-5")
        .when(k == 3, "true").when(k == 4, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("1e14")
    )
    return table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("order_key", text_fn.order_key(F.col("raw")))


@query("""
WITH f AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 - CASE WHEN event_id % 7 = 0 THEN 200000 ELSE 0 END AS k FROM events)
SELECT event_id, coalesce(k < max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM f""")
def disorder(spark, d):
    """Rows whose order key falls behind their partition's cursor."""
    key = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.when(F.col("event_id") % 7 == 0, 200000).otherwise(0)
    return sessions.in_order(table(spark, d, "events").withColumn("k", key), ["user_id"], "event_id", "k").select("event_id", "late")


_SESSIONS = """
e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS k FROM events),
g AS (SELECT *, CASE WHEN k - lag(k) OVER w > 40000 THEN 'gap' END AS why FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(CASE WHEN why IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1) // 8 AS part FROM r),
s AS (SELECT user_id, run, part, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS len,
       sha256(string_agg(event_type, chr(10) ORDER BY event_id)) AS sha, arg_min(coalesce(why, 'none'), event_id) AS began FROM p GROUP BY ALL)"""


@query(f"""WITH {_SESSIONS}
SELECT user_id, substr(sha, 1, 16) AS session_id, row_number() OVER (PARTITION BY sha ORDER BY first_seq) - 1 AS repeat, first_seq, last_seq, len,
  CASE WHEN len = 8 THEN 'max_len' WHEN lead(first_seq) OVER w IS NULL THEN 'eof' ELSE lead(began) OVER w END AS cause
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY first_seq)""")
def event_sessions(spark, d):
    """Sessions of each user: gaps, a length cap, causes, and ids from the members' content."""
    return sessions.sessions(_frames(spark, d), ["user_id"], "event_id", "k", "event_type", gap_s=40000, max_len=8)


def _frames(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("k"))


@query(f"""WITH {_SESSIONS}
SELECT user_id, count(*) AS sessions, sum(len)::BIGINT AS frames, sum(len) / count(*) AS mean_len FROM s GROUP BY user_id""")
def session_stats(spark, d):
    rows = sessions.sessions(_frames(spark, d), ["user_id"], "event_id", "k", "event_type", gap_s=40000, max_len=8)
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("len").alias("frames"), (F.sum("len") / F.count("*")).alias("mean_len"))


@query("""
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT user_id, n, unnest(range(0, greatest(n - 1, 1), 19)) AS "start" FROM n)
SELECT user_id, "start", least("start" + 20, n) AS "end" FROM s""")
def judge_windows(spark, d):
    """Windows of 20 frames with one frame shared, for each user's stream."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(sessions.window_spans(F.col("n"), 20)).alias("w")).select("user_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER w - 1 AS pos, length(props) + 3 AS c, sum(length(props) + 3) OVER w AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT a.user_id, a.pos AS "start", a.n, least(greatest(coalesce((SELECT max(b.pos) + 1 FROM e b WHERE b.user_id = a.user_id AND b.pos >= a.pos AND b.pos < a.pos + 20 AND b.s - (a.s - a.c) <= 120), 0), a.pos + 2), a.n) AS "end" FROM e a),
w AS (SELECT user_id, "start", "end", n FROM g WHERE "start" = 0 UNION ALL SELECT g.user_id, g."start", g."end", g.n FROM w JOIN g ON g.user_id = w.user_id AND g."start" = w."end" - 1 WHERE w."end" < w.n)
SELECT user_id, "start", "end" FROM w""")
def packed_windows(spark, d):
    """Windows packed by cost under a budget, whatever the length of a stream."""
    placed = lanes.numbered(table(spark, d, "events").select("user_id", "event_id", "props"), ["user_id"], ["event_id"], "_n")
    costs = placed.select("user_id", (F.col("_n") - 1).alias("pos"), (F.length("props") + 3).alias("c"))
    return sessions.budget_windows(costs, ["user_id"], "pos", "c", 120, 20)


_REL = "CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'context_switch' WHEN (SELECT max(event_type) FROM events) THEN 'interruption' ELSE 'continues' END"


@query(f"""
WITH f AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, {_REL} AS relation FROM events),
l AS (SELECT *, CASE WHEN relation <> 'interruption' THEN row_number() OVER (PARTITION BY user_id, relation = 'interruption' ORDER BY pos) END AS rk FROM f),
c AS (SELECT *, CASE WHEN relation <> 'interruption' THEN sum(CASE WHEN relation = 'context_switch' AND rk > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) END AS segment FROM l),
z AS (SELECT *, CASE WHEN segment IS NOT NULL THEN count(*) OVER (PARTITION BY user_id, segment) END AS seg_len, max(segment) OVER (PARTITION BY user_id) AS parts FROM c)
SELECT event_id, segment::BIGINT AS segment, seg_len, CASE WHEN segment IS NULL THEN 'noise' WHEN parts > 0 AND seg_len < 2 THEN 'below_min_len' END AS reason,
  CASE WHEN segment IS NULL OR (parts > 0 AND seg_len < 2) THEN 'dropped_noise' ELSE 'active' END AS status FROM z""")
def segment_assembly(spark, d):
    """Segments from frame relations: boundaries cut, noise and short segments go with their reason."""
    return _segmented(spark, d).select("event_id", "segment", "seg_len", "reason", "status")


def _segmented(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    edge = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    rel = F.when(F.col("event_type") == F.col("lo"), "context_switch").when(F.col("event_type") == F.col("hi"), "interruption").otherwise("continues")
    placed = lanes.numbered(e, ["user_id"], ["event_id"], "_n")
    frames = placed.crossJoin(F.broadcast(edge)).select("event_id", "user_id", (F.col("_n") - 1).alias("pos"), rel.alias("relation"))  # one row
    return sessions.segments(frames, "user_id", "pos", "relation")


@query("""
WITH f AS (SELECT conv_id, turn, text FROM conversations), p AS (SELECT conv_id, row_number() OVER w - 1 AS idx, text AS prev, lead(text) OVER w AS curr FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, idx, sha256(prev) AS prev, sha256(curr) AS curr FROM p WHERE curr IS NOT NULL""")
def adjacent_turns(spark, d):
    """Adjacent pairs of each conversation, numbered."""
    pairs = sessions.adjacent_pairs(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return pairs.select("conv_id", "idx", F.sha2("prev", 256).alias("prev"), F.sha2("curr", 256).alias("curr"))


@query("""
WITH m AS (SELECT user_id % 10 AS session, event_type AS thread, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS pos FROM events),
p AS (SELECT session, thread, pos AS left_pos, lead(pos) OVER (PARTITION BY session, thread ORDER BY pos) AS right_pos FROM m)
SELECT session, thread, left_pos, right_pos, right_pos - left_pos - 1 AS foreign_frames FROM p WHERE right_pos - left_pos > 1""")
def thread_seams(spark, d):
    """Gaps of threads that hold frames of other threads."""
    e = lanes.numbered(table(spark, d, "events").select((F.col("user_id") % 10).alias("session"), F.col("event_type").alias("thread"), "event_id"), ["session"], ["event_id"], "pos")
    return sessions.seams(e, "session", "thread", "pos").withColumnRenamed("foreign", "foreign_frames")


@query("""
WITH f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
e AS (SELECT conv_id, 3 AS head, 4 AS tail FROM f GROUP BY conv_id HAVING count(*) >= 4)
SELECT e.conv_id, f.pos, f.turn FROM e JOIN f ON e.conv_id = f.conv_id AND (f.pos BETWEEN 1 AND 2 OR f.pos BETWEEN 5 AND 6)""")
def boundary_margins(spark, d):
    """The two frames before and behind an episode (places 3 to 4 of a conversation)."""
    c = table(spark, d, "conversations")
    frames = c.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("pos"))
    episodes = frames.groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 4").select("conv_id", F.lit("e").alias("episode_id"), F.lit(3).alias("head"), F.lit(4).alias("tail"))
    return sessions.margins(episodes, frames, "conv_id", "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "turn")


@query(f"""
WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, {_REL} AS relation FROM events),
r AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM f WHERE relation = 'interruption')
SELECT user_id, min(pos) AS run_start, max(pos) AS run_end, count(*) AS len FROM r GROUP BY user_id, g""")
def rescue_runs(spark, d):
    """Contiguous runs of noise frames."""
    noise = _segmented(spark, d).where("reason = 'noise'").select("user_id", F.col("pos").cast("long").alias("pos"))
    return sessions.rescue_runs(noise, "user_id", "pos")


@query("""
SELECT n, unnest(CASE WHEN n <= 20 THEN range(0, n) ELSE list_transform(range(0, 20), lambda i: i * (n - 1) // 19) END) AS frame
FROM (SELECT conv_id, count(*) * 5 AS n FROM conversations GROUP BY 1)""")
def keyframes(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg((F.count("*") * 5).alias("n"))
    return n.select("n", F.explode(text_fn.keyframes(F.col("n"), 20)).alias("frame")).withColumn("frame", F.col("frame").cast("long"))


@query("""
WITH r AS (SELECT unnest(range(1, 5)) AS round), k AS (SELECT lang, round, doc_id, sha256('0|' || round || '|' || doc_id) AS h FROM documents, r),
n AS (SELECT *, row_number() OVER w - 1 AS p, lead(doc_id) OVER w AS second FROM k WINDOW w AS (PARTITION BY lang, round ORDER BY h))
SELECT lang, round::INT AS round, doc_id AS first, second, substr(h, 1, 1) < '8' AS first_is_a FROM n WHERE p % 2 = 0 AND second IS NOT NULL""")
def pairing_plan(spark, d):
    """Four rounds of random pairs in each language's pool."""
    return quality.pairing_plan(table(spark, d, "documents"), ["lang"], "doc_id", 4)


@query()
def bradley_terry_scores(spark, d):
    """Strengths from pairwise verdicts by length, in each language's batches of 256."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    pooled = lanes.numbered(docs, ["lang"], ["doc_id"], "_n").select("doc_id", "lang", "n_chars", F.floor((F.col("_n") - 1) / 256).alias("batch_no"))
    plan = quality.pairing_plan(pooled, ["lang", "batch_no"], "doc_id", 4)
    size = [pooled.select(F.col("doc_id").alias(c), F.col("n_chars").alias(f"_{c}")) for c in ("first", "second")]
    judged = plan.join(size[0], "first").join(size[1], "second")
    winner = F.when(F.abs(F.col("_first") - F.col("_second")) < 50, "tie").when(F.col("_first") > F.col("_second"), "A").otherwise("B")
    return quality.fit_pools(judged.withColumn("winner", winner), ["lang", "batch_no"])


@query(f"""
WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars % 50) AS rk, count(*) OVER (PARTITION BY lang, n_chars % 50) AS peers, count(*) OVER (PARTITION BY lang) AS n FROM scores)
SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN n = 1 THEN 0.5 ELSE (rk - 1 + (peers - 1) / 2.0) / (n - 1) END AS pct FROM r""")
def percentiles(spark, d):
    """Percentile scores by average rank; unscored rows count for the ranks and have no score."""
    rows = _scores(spark, d).withColumn("v", F.col("n_chars") % 50)
    return ranks.percentiles(rows, ["lang"], "v").select("doc_id", F.when(F.col("quality").isNotNull(), F.col("pct")).alias("pct"))


_LONG = f"WITH {SCORES}, c(criterion, weight) AS (VALUES ('clarity', 1.0::DOUBLE), ('depth', 1.5::DOUBLE), ('form', 0.5::DOUBLE)), l AS (SELECT doc_id, lang, criterion, weight, CASE WHEN (doc_id + length(criterion)) % 5 <> 0 THEN score END AS score FROM scores, c)"


def _long(spark, d):
    rows = _scores(spark, d)
    crit = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(w).alias("weight")) for c, w in (("clarity", 1.0), ("depth", 1.5), ("form", 0.5))]))
    long = rows.select("doc_id", "lang", "score", crit.alias("c")).select("doc_id", "lang", "c.criterion", "c.weight", "score")
    return long.withColumn("score", F.when((F.col("doc_id") + F.length("criterion")) % 5 != 0, F.col("score")))


@query(_LONG + " SELECT doc_id, round(sum(weight * score) / sum(CASE WHEN score IS NOT NULL THEN weight END), 9) AS aggregate FROM l GROUP BY doc_id")
def weighted_aggregate(spark, d):
    return quality.weighted_mean(_long(spark, d), ["doc_id"], "score", "weight").withColumn("aggregate", F.round("aggregate", 9))


@query(_LONG + ", b AS (SELECT lang, criterion, score, least(floor(score * 10), 9) AS b FROM l WHERE score IS NOT NULL) SELECT lang, criterion, round(avg(score), 9) AS mean_score, count(*) AS n, " + ", ".join(f"count(*) FILTER (b = {k}) AS b{k}" for k in range(10)) + " FROM b GROUP BY GROUPING SETS ((lang, criterion), (criterion))")
def score_report(spark, d):
    return quality.score_report(_long(spark, d), "lang", "criterion", "score").withColumn("mean_score", F.round("mean_score", 9))


@query(f"""
WITH {SCORES}, r AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY lang, score IS NOT NULL ORDER BY score DESC, doc_id) END AS rk, ceil(0.3 * count(score) OVER (PARTITION BY lang)) AS quota FROM scores)
SELECT doc_id, rk AS rank, CASE WHEN score IS NULL THEN 'active' WHEN rk <= quota THEN 'active' ELSE 'dropped_lowq' END AS top_status,
  CASE WHEN score IS NULL THEN 'dropped_lowq' WHEN score >= 0.6 THEN 'active' ELSE 'dropped_lowq' END AS threshold_status FROM r""")
def quality_gates(spark, d):
    """Both gates: the best share of each pool, and a threshold that drops unscored rows."""
    rows = quality.top_ratio(_scores(spark, d), ["lang"], "score", "doc_id", 0.3)
    return rows.select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("status").alias("top_status"), quality.threshold_gate(F.col("score"), 0.6, "drop").alias("threshold_status"))


_VOTES = "v AS (SELECT o_orderkey, j, CASE (o_orderkey * 7 + j * 13 + o_custkey) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'A' WHEN 2 THEN 'A' WHEN 3 THEN 'B' ELSE 'tie' END AS verdict FROM orders, (SELECT unnest(range(0, 3)) AS j))"


def _votes(spark, d):
    j = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", j)
    k = (F.col("o_orderkey") * 7 + F.col("j") * 13 + F.col("o_custkey")) % 5
    return rows.select("o_orderkey", "j", F.when(k == 0, None).when(k <= 2, "A").when(k == 3, "B").otherwise("tie").alias("verdict"))


@query(f"WITH {_VOTES} SELECT o_orderkey, CASE WHEN count(verdict) = 0 THEN NULL WHEN 2 * count(*) FILTER (verdict = 'A') > count(*) THEN 'A' WHEN 2 * count(*) FILTER (verdict = 'B') > count(*) THEN 'B' ELSE 'tie' END AS winner FROM v GROUP BY 1")
def panel_majority(spark, d):
    return quality.panel_majority(_votes(spark, d), ["o_orderkey"], "verdict")


@query(f"WITH {_VOTES} SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NOT DISTINCT FROM b THEN a ELSE 'tie' END AS composed FROM (SELECT o_orderkey, max(verdict) FILTER (j = 0) AS a, max(verdict) FILTER (j = 1) AS b FROM v GROUP BY 1)")
def both_orders(spark, d):
    v = _votes(spark, d).groupBy("o_orderkey").agg(*[F.max(F.when(F.col("j") == k, F.col("verdict"))).alias(c) for k, c in enumerate("ab")])
    return v.select("o_orderkey", quality.compose_orders(F.col("a"), F.col("b")).alias("composed"))


@query(f"WITH {_VOTES} SELECT j, count(*) AS judged, count(*) FILTER (verdict = 'tie') / count(*) AS tie_rate FROM v WHERE verdict IS NOT NULL GROUP BY GROUPING SETS ((j), ())")
def tie_rates(spark, d):
    return quality.tie_rate(_votes(spark, d), "j", "verdict")


_SAMPLES = "s AS (SELECT c_custkey, j, CASE WHEN (c_custkey + j) % 11 = 0 THEN NULL ELSE list_filter(['math', 'code', 'other'], lambda x: (c_custkey * 3 + j * length(x) + c_nationkey) % 3 < 2 AND NOT (x = 'other' AND (c_custkey * 3 + j * 4 + c_nationkey) % 3 < 2)) END AS labels FROM customer, (SELECT unnest(range(0, 3)) AS j))"


@query(f"""WITH {_SAMPLES}, v AS (SELECT c_custkey, x, count(*) AS n FROM (SELECT c_custkey, unnest(labels) AS x FROM s) GROUP BY ALL),
w AS (SELECT c_custkey, list(x ORDER BY CASE x WHEN 'math' THEN 1 WHEN 'code' THEN 2 ELSE 3 END) AS labels, min(n) AS n FROM v WHERE 2 * n > 3 GROUP BY 1)
SELECT c.c_custkey, array_to_string(coalesce(w.labels, ['other']), ',') AS labels, coalesce(w.n, (SELECT n FROM v WHERE v.c_custkey = c.c_custkey AND x = 'other'), 0) / 3 AS agreement
FROM customer c LEFT JOIN w ON w.c_custkey = c.c_custkey""")
def label_votes(spark, d):
    """Labels by majority of three samples, some of which abstain."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    k = lambda n: (F.col("c_custkey") * 3 + F.col("j") * n + F.col("c_nationkey")) % 3 < 2
    raw = F.array_compact(F.array(F.when(k(4), "math"), F.when(k(4), "code"), F.when(k(5), "other")))
    labels = votes.normalized_labels(raw, ["math", "code", "other"], "other")
    s = c.withColumn("labels", F.when((F.col("c_custkey") + F.col("j")) % 11 != 0, labels))
    out = votes.label_votes(s, ["c_custkey"], "labels", 3, ["math", "code", "other"], "other")
    return out.select("c_custkey", F.array_join("labels", ",").alias("labels"), "agreement")


@query(f"WITH {_SAMPLES} SELECT c_custkey, generate_subscripts(labels, 1) - 1 AS fan_pos, unnest(labels) AS label FROM s WHERE j = 0")
def label_fan_out(spark, d):
    c = table(spark, d, "customer").withColumn("j", F.lit(0))
    k = lambda n: (F.col("c_custkey") * 3 + F.col("c_nationkey")) % 3 < 2
    raw = F.array_compact(F.array(F.when(k(4), "math"), F.when(k(4), "code"), F.when(k(5), "other")))
    labels = F.when(F.col("c_custkey") % 11 != 0, votes.normalized_labels(raw, ["math", "code", "other"], "other"))
    return votes.fan_out(c.select("c_custkey", labels.alias("labels")), "labels").select("c_custkey", F.col("fan_pos").cast("long").alias("fan_pos"), "label")


_FIELDS = "f AS (SELECT l_orderkey, l_linenumber, l_returnflag AS a, l_linestatus AS b FROM lineitem)"


@query(f"""WITH {_FIELDS}, ca AS (SELECT l_orderkey, a, count(*) AS n FROM f GROUP BY ALL), cb AS (SELECT l_orderkey, b, count(*) AS n FROM f GROUP BY ALL),
ma AS (SELECT l_orderkey, min(a) AS a, count(*) AS t FROM ca WHERE n = (SELECT max(n) FROM ca c2 WHERE c2.l_orderkey = ca.l_orderkey) GROUP BY 1),
mb AS (SELECT l_orderkey, min(b) AS b, count(*) AS t FROM cb WHERE n = (SELECT max(n) FROM cb c2 WHERE c2.l_orderkey = cb.l_orderkey) GROUP BY 1),
h AS (SELECT f.l_orderkey, min(l_linenumber) FILTER (ma.t = 1 AND mb.t = 1 AND f.a = ma.a AND f.b = mb.b) AS hit, min(l_linenumber) AS first FROM f JOIN ma USING (l_orderkey) JOIN mb USING (l_orderkey) GROUP BY 1),
p AS (SELECT h.l_orderkey, coalesce(hit, first) AS chosen, hit IS NULL AS disagreed, f.a, f.b FROM h JOIN f ON f.l_orderkey = h.l_orderkey AND f.l_linenumber = coalesce(hit, first))
SELECT p.l_orderkey, chosen, disagreed, count(*) AS matches FROM p JOIN f ON f.l_orderkey = p.l_orderkey AND f.a = p.a AND f.b = p.b GROUP BY ALL""")
def field_votes(spark, d):
    """Field-wise majority over the lines of each order taken as samples."""
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return votes.field_vote(f, ["l_orderkey"], "l_linenumber", ["a", "b"])


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_returnflag, l_linestatus FROM c WHERE 2 * n > (SELECT sum(n) FROM c d WHERE d.l_orderkey = c.l_orderkey)""")
def thread_votes(spark, d):
    """The combination of verdict and thread that more than half of the samples name."""
    return votes.strict_majority(table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("SELECT l_orderkey, CASE WHEN 2 * count(*) FILTER (l_returnflag = 'R') > count(*) THEN 'fail' ELSE 'pass' END AS verdict FROM lineitem GROUP BY 1")
def verdict_votes(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass").alias("verdict"))
    return votes.verdict_majority(v, ["l_orderkey"], "verdict")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber AS judge, ['label_mismatch', 'off_task_members', 'missing_head', 'missing_tail', 'missing_members', 'wrong_stitch'][1 + l_partkey % 6] AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'head' ELSE '' END AS position, CAST(l_quantity % 3 AS INT)::VARCHAR AS members FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind, position, members ORDER BY judge) AS k FROM d)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY list_position(['label_mismatch', 'off_task_members', 'missing_head', 'missing_tail', 'missing_members', 'wrong_stitch'], kind), position, members) AS ord, kind, position, members, judge FROM f WHERE k = 1""")
def defect_union(spark, d):
    """Defects that several judges name, each once and in order."""
    kinds = F.array(*[F.lit(k) for k in votes.DEFECTS])
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("judge"), F.get(kinds, (F.col("l_partkey") % 6).cast("int")).alias("kind"),
        F.when(F.col("l_suppkey") % 2 == 0, "head").otherwise("").alias("position"), (F.col("l_quantity") % 3).cast("int").cast("string").alias("members"),
    )
    return votes.defect_union(rows, ["l_orderkey"], "judge", "kind", "position", "members")


@query("SELECT x AS lang, (SELECT count(*) FROM documents WHERE lang = x) AS n FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS x)")
def class_histogram(spark, d):
    """Count of each declared class, absent ones with 0."""
    return votes.zero_based(table(spark, d, "documents"), "lang", ["en", "fr", "de", "es", "it"])


@query(f"""WITH {SCORES}, m AS (SELECT lang, median(score) AS t FROM scores WHERE score IS NOT NULL GROUP BY 1)
SELECT doc_id, s.lang, coalesce(CASE WHEN s.lang = 'en' THEN 0.8 END, t) AS seed_threshold FROM scores s JOIN m ON m.lang = s.lang WHERE score >= coalesce(CASE WHEN s.lang = 'en' THEN 0.8 END, t)""")
def seed_selection(spark, d):
    """Seeds by class threshold, else by the class's median."""
    own = spark.range(1).select(F.lit("en").alias("lang"), F.lit(0.8).alias("threshold"))
    rows = _scores(spark, d).withColumn("status", F.lit("active"))
    return generate.seeds(rows, "lang", "score", "status", class_thresholds=own).select("doc_id", "lang", "seed_threshold")


@query(f"""WITH {SCORES}, t AS (SELECT doc_id, score, CASE WHEN doc_id % 10 = 0 THEN 'dropped_dup' WHEN doc_id % 10 = 1 THEN 'failed' WHEN doc_id % 10 = 2 THEN 'absorbed' WHEN doc_id % 10 = 3 THEN 'dropped_noise' WHEN score < 0.5 THEN 'dropped_lowq' ELSE 'active' END AS status FROM scores)
SELECT doc_id, status, CASE WHEN status = 'active' THEN 'main' WHEN status = 'absorbed' THEN 'counted' ELSE 'rejects' END AS channel,
  CASE status WHEN 'dropped_dup' THEN 'dedup' WHEN 'failed' THEN 'annotate' WHEN 'dropped_noise' THEN 'segment' WHEN 'dropped_lowq' THEN 'quality' END AS stage,
  CASE status WHEN 'dropped_dup' THEN 'exact' WHEN 'failed' THEN 'schema_violation' WHEN 'dropped_noise' THEN 'noise' WHEN 'dropped_lowq' THEN 'below_threshold' END AS reason FROM t""")
def routing(spark, d):
    """Where each row goes and why."""
    rows = _routed(spark, d)
    why = emit.reject_reason(F.col("status"), F.lit("exact"), "threshold", F.lit("segment"), F.lit("noise"), F.lit("annotate"), F.lit("schema_violation"))
    return rows.select("doc_id", "status", emit.channel(F.col("status")).alias("channel"), why.alias("w")).select("doc_id", "status", "channel", "w.stage", "w.reason")


def _routed(spark, d):
    k = F.col("doc_id") % 10
    status = F.when(k == 0, "dropped_dup").when(k == 1, "failed").when(k == 2, "absorbed").when(k == 3, "dropped_noise").when(F.col("score") < 0.5, "dropped_lowq").otherwise("active")
    return _scores(spark, d).withColumn("status", status)


@query(f"""WITH {SCORES}, t AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'dropped_dup' WHEN doc_id % 10 = 1 THEN 'failed' WHEN doc_id % 10 = 2 THEN 'absorbed' WHEN doc_id % 10 = 3 THEN 'dropped_noise' WHEN score < 0.5 THEN 'dropped_lowq' ELSE 'active' END AS status FROM scores)
SELECT {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in emit.STATUSES)}, 0 AS unknown, 5 AS bad_input, true AS balanced FROM t""")
def conservation(spark, d):
    """Accounts of a run: every row that came in has one status."""
    rows = _routed(spark, d)
    return emit.accounts(rows, "status", bad_input=5, scanned=table(spark, d, "documents").count() + 5)


@query("""
WITH t AS (SELECT page_id % 40 AS idx, page_id FROM pages WHERE page_id % 7 <> 0), i AS (SELECT item_id % 45 AS idx, item_id FROM benchmark WHERE item_id % 5 <> 0),
a AS (SELECT idx, count(*) AS n, min(page_id)::VARCHAR AS p FROM t GROUP BY 1), b AS (SELECT idx, count(*) AS n, min(item_id)::VARCHAR AS p FROM i GROUP BY 1)
SELECT coalesce(a.idx, b.idx) AS idx, a.p AS tree, b.p AS image, CASE WHEN a.n > 1 OR b.n > 1 THEN 'conflict' WHEN b.n IS NULL THEN 'missing_image' WHEN a.n IS NULL THEN 'missing_tree' ELSE 'pair' END AS state FROM a FULL JOIN b ON a.idx = b.idx""")
def capture_pairs(spark, d):
    """Two sides joined on an index: pairs, missing sides, conflicts."""
    from millrace.sources import ui

    trees = table(spark, d, "pages").where("page_id % 7 <> 0").select((F.col("page_id") % 40).alias("idx"), F.col("page_id"))
    images = table(spark, d, "benchmark").where("item_id % 5 <> 0").select((F.col("item_id") % 45).alias("idx"), F.col("item_id").alias("page_id"))
    out = ui.pair(trees, images, path="page_id")
    return out.select("idx", F.col("tree").cast("string").alias("tree"), F.col("image").cast("string").alias("image"), "state")


@query("""
WITH a AS (SELECT page_id AS idx, count(*) AS n, min(page_id)::VARCHAR AS p FROM pages GROUP BY 1), b AS (SELECT item_id AS idx, count(*) AS n, min(item_id)::VARCHAR AS p FROM benchmark GROUP BY 1)
SELECT coalesce(a.idx, b.idx) AS idx, a.p AS tree, b.p AS image, CASE WHEN a.n > 1 OR b.n > 1 THEN 'conflict' WHEN b.n IS NULL THEN 'missing_image' WHEN a.n IS NULL THEN 'missing_tree' ELSE 'pair' END AS state FROM a FULL JOIN b ON a.idx = b.idx""")
def capture_pairs_by_id(spark, d):
    """Two whole tables joined on their own ids."""
    from millrace.sources import ui

    trees = table(spark, d, "pages").select(F.col("page_id").alias("idx"), "page_id")
    images = table(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.col("item_id").alias("page_id"))
    out = ui.pair(trees, images, path="page_id")
    return out.select("idx", F.col("tree").cast("string").alias("tree"), F.col("image").cast("string").alias("image"), "state")


@query()
def generation_plan(spark, d):
    """Calls that grow the set from its seeds."""
    rows = generate.seeds(_scores(spark, d).withColumn("status", F.lit("active")), "lang", "score", "status")
    return generate.call_plan(rows, "lang", "doc_id", ["a", "b"], ["plain", "short"])
