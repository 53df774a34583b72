"""Queries over what judges are asked and what their answers come to, and further operators, each with DuckDB SQL.

Answers come from rules over columns here, some of them out of shape, as a table judge would give them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import fit, shapes, ui
from millrace.functions import text as text_fn
from millrace.operators import chains, dedup, generate, quality, review, sessions, stitch, votes
from millrace.plans import calls
from millrace.runtime import Written, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _frames(spark, d):
    own = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", (F.row_number().over(own) - 1).alias("pos"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("k"))


_POS = "f AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_NAMES = "['" + "', '".join(shapes.RELATIONS) + "']"


@query(f"""WITH {_POS}, w AS (SELECT *, CASE WHEN pos > 0 AND pos % 19 = 0 AND pos = n - 1 THEN pos // 19 - 1 ELSE pos // 19 END AS w FROM f)
SELECT user_id, pos, CASE WHEN user_id % 13 = 0 OR (pos - w * 19) % 7 = 6 THEN 'continues' ELSE {_NAMES}[1 + ((user_id + pos - w * 19) % 5)::INT] END AS relation, user_id % 13 = 0 AS degraded FROM w""")
def window_relations(spark, d):
    """Relations of frames from answers by window: the later window counts, absent frames continue, a bad window degrades its session."""
    plan = calls.window_calls(_frames(spark, d), "user_id", "pos", "event_type", 20)
    names = F.array(*[F.lit(r) for r in shapes.RELATIONS])
    entry = lambda i: F.struct(i.alias("index"), F.get(names, ((F.col("user_id") + i) % 5).cast("int")).alias("relation"))
    each = F.filter(F.sequence(F.lit(0), (F.col("end") - F.col("start") - 1).cast("int")), lambda i: i % 7 != 6)
    twice = F.concat(F.transform(each, entry), F.array(F.struct(F.lit(0).alias("index"), F.lit("interruption").alias("relation"))))  # the first entry of a frame counts
    bad = (F.col("user_id") % 13 == 0) & (F.col("start") == 0)
    answers = plan.withColumn("answer", F.when(bad, "no idea").otherwise(F.to_json(F.struct(twice.alias("frames")))))
    told = calls.window_relations(answers, "user_id")
    flags = told.groupBy("user_id").agg(F.bool_or("degraded").alias("degraded"))
    return sessions.stitched_relations(told, "user_id", "pos", "start", "relation").join(flags, "user_id")


_RELATION = "CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'context_switch' WHEN (SELECT max(event_type) FROM events) THEN 'interruption' ELSE 'continues' END"
_SEGMENTS = f"""{_POS}, l AS (SELECT *, {_RELATION} AS relation FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, relation = 'interruption' ORDER BY pos) AS rk FROM l),
s AS (SELECT *, sum(CASE WHEN relation = 'context_switch' AND rk > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS segment FROM c),
z AS (SELECT user_id, segment, count(*) AS len, min(pos) AS head, max(pos) AS tail, substr(sha256(string_agg(event_id::VARCHAR, chr(10) ORDER BY pos)), 1, 16) AS episode_id FROM s WHERE relation <> 'interruption' GROUP BY ALL),
e AS (SELECT * FROM z WHERE len >= 2 OR (SELECT max(segment) FROM s WHERE s.user_id = z.user_id) = 0)"""


def _assembled(spark, d):
    from millrace.plans.registry import _segmented

    return _segmented(spark, d)


@query(f"WITH {_SEGMENTS} SELECT user_id, segment::BIGINT AS segment, episode_id, head, tail, len FROM e")
def episodes(spark, d):
    """Episodes of the active frames of each user's segments."""
    out = calls.episodes(_assembled(spark, d), "user_id", "pos", "event_id").drop("members")
    return out.select("user_id", F.col("segment").cast("long").alias("segment"), "episode_id", F.col("head").cast("long").alias("head"), F.col("tail").cast("long").alias("tail"), F.col("len").cast("long").alias("len"))


@query(f"WITH {_SEGMENTS} SELECT 'absorbed' AS status, sum(len)::BIGINT AS n FROM e UNION ALL SELECT 'dropped_noise', (SELECT count(*) FROM events) - (SELECT sum(len) FROM e)::BIGINT")
def absorbed_frames(spark, d):
    """Frames by status once their episodes stand for them."""
    return calls.absorbed(_assembled(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


_PAIRS = "t AS (SELECT conv_id, row_number() OVER w - 1 AS idx, text, lead(text) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id, idx, (conv_id + idx) % 11 AS r, (conv_id + idx) % 5 = 0 AS seam FROM t WHERE nxt IS NOT NULL)"


@query(f"""WITH {_PAIRS}, a AS (SELECT *, CASE WHEN seam THEN 'app_switch' WHEN r = 5 THEN 'other' ELSE ['{"', '".join(shapes.ACTIONS)}'][1 + r] END AS action_type, NOT seam AND r <> 5 AS said FROM p),
v AS (SELECT *, CASE WHEN said THEN 'x' || idx END AS target, CASE WHEN said AND r <> 7 THEN CASE WHEN action_type = 'scroll' THEN 'down' ELSE 'Down' END END AS value FROM a)
SELECT conv_id, idx, action_type, target, value, CASE WHEN seam THEN 'thread_seam' WHEN r = 5 THEN 'extraction_invalid' END AS kind,
idx || '. ' || action_type || ' (on ' || coalesce(target, '-') || ', value ' || coalesce(value, '-') || ') ' || CASE WHEN seam THEN 'back after mail [seam]' WHEN r = 5 THEN ' [not recognised]' ELSE 'did' END AS line FROM v""")
def step_verdicts(spark, d):
    """Steps between neighbours: seams without a call, answers out of shape as other steps, a line of text for each."""
    pairs = sessions.adjacent_pairs(table(spark, d, "conversations"), "conv_id", "turn", "text")
    pairs = pairs.withColumn("seam", (F.col("conv_id") + F.col("idx")) % 5 == 0).withColumn("interrupted_by", F.array(F.lit("mail")))
    plan = calls.step_calls(pairs, ["conv_id", "idx"], "prev", "curr")
    r = ((F.col("conv_id") + F.col("idx")) % 11).cast("int")
    said = F.struct(F.get(F.array(*[F.lit(a) for a in shapes.ACTIONS]), r).alias("action_type"), F.concat(F.lit("x"), F.col("idx").cast("string")).alias("target"), F.when(r != 7, "Down").alias("value"), F.lit("did").alias("description"))
    answers = plan.withColumn("answer", F.when(r == 5, '{"action_type": "jump"}').otherwise(F.to_json(said, {"ignoreNullFields": "false"})))
    out = calls.steps(pairs, answers, ["conv_id", "idx"])
    line = calls.step_line(F.col("idx"), F.col("action_type"), F.col("target"), F.col("value"), F.col("description"), F.col("kind"))
    return out.select("conv_id", F.col("idx").cast("long").alias("idx"), "action_type", "target", "value", "kind", line.alias("line"))


_CLASS = "s AS (SELECT doc_id, j, ['code', 'prose', 'other', 'bogus', NULL][1 + ((doc_id * 3 + j * j) % 5)::INT] AS label FROM documents, (SELECT unnest(range(0, 3)) AS j))"


@query(f"""WITH {_CLASS}, k AS (SELECT doc_id, CASE WHEN label IN ('code', 'prose', 'other') THEN label END AS label FROM s),
v AS (SELECT doc_id, label, count(*) AS n FROM k WHERE label IS NOT NULL GROUP BY ALL),
w AS (SELECT doc_id, arg_max(label, n) AS label, max(n) AS n FROM v WHERE 2 * n > 3 GROUP BY 1)
SELECT d.doc_id, coalesce(w.label, 'other') AS labels, coalesce(w.n, (SELECT n FROM v WHERE v.doc_id = d.doc_id AND v.label = 'other'), 0) / 3 AS agreement,
CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.doc_id = d.doc_id) THEN 'judge' ELSE 'fallback' END AS source FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id""")
def class_verdicts(spark, d):
    """Classes of three answers each: unknown ones and answers out of shape abstain."""
    docs = table(spark, d, "documents").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    plan = calls.class_calls(docs, ["doc_id", "j"], "text", [{"name": n} for n in ("code", "prose", "other")])
    said = F.get(F.array(*[F.lit(c) for c in ("code", "prose", "other", "bogus")], F.lit(None)), ((F.col("doc_id") * 3 + F.col("j") * F.col("j")) % 5).cast("int"))
    answers = plan.withColumn("answer", F.when(said.isNull(), "none of them").otherwise(F.to_json(F.struct(said.alias("class")))))
    out = calls.class_verdicts(answers, ["doc_id"], ["code", "prose", "other"], "other", samples=3)
    return out.withColumn("labels", F.array_join("labels", ","))


@query("""WITH r AS (SELECT unnest(range(1, 3)) AS round), h AS (SELECT lang, round, doc_id, length(text) AS n, sha256('0|' || round || '|' || doc_id) AS k FROM documents, r),
p AS (SELECT lang, round, doc_id AS first, n AS a, lead(doc_id) OVER w AS second, lead(n) OVER w AS b, row_number() OVER w AS q FROM h WINDOW w AS (PARTITION BY lang, round ORDER BY k)),
t AS (SELECT * FROM p WHERE q % 2 = 1 AND second IS NOT NULL),
j AS (SELECT *, CASE WHEN abs(a - b) < 40 THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS fair, 'tie' AS biased, CASE WHEN (first + second) % 3 = 0 THEN NULL WHEN a >= b THEN 'A' ELSE 'B' END AS moody FROM t)
SELECT lang, round::INT AS round, first, second, CASE WHEN 2 * ((fair = 'A')::INT + (coalesce(moody, '') = 'A')::INT) > 3 THEN 'A' WHEN 2 * ((fair = 'B')::INT + (coalesce(moody, '') = 'B')::INT) > 3 THEN 'B' ELSE 'tie' END AS winner FROM j""")
def comparison_verdicts(spark, d):
    """Pairs by three judges in both orders: a fair one, one that always prefers A, one that sometimes fails."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", F.length("text").alias("n"))
    plan = quality.pairing_plan(docs, ["lang"], "doc_id", 2)
    asked = calls.comparison_calls(plan, docs, ["lang"], "doc_id", "text", ["length"], ["fair", "biased", "moody"], both_orders=True)
    size = [docs.select(F.col("doc_id").alias(c), F.col("n").alias(f"_{c}")) for c in ("first", "second")]
    rows = asked.drop("prompt").join(size[0], "first").join(size[1], "second")
    a, b = F.when(F.col("flipped"), F.col("_second")).otherwise(F.col("_first")), F.when(F.col("flipped"), F.col("_first")).otherwise(F.col("_second"))
    fair = F.when(F.abs(a - b) < 40, "tie").when(a > b, "A").otherwise("B")
    moody = F.when((F.col("first") + F.col("second")) % 3 == 0, None).when(F.col("_first") >= F.col("_second"), F.when(F.col("flipped"), "B").otherwise("A")).otherwise(F.when(F.col("flipped"), "A").otherwise("B"))
    said = F.when(F.col("judge") == "fair", fair).when(F.col("judge") == "biased", "A").otherwise(moody)
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("length").alias("criterion"), said.alias("winner"))).alias("judgments")))
    answers = rows.withColumn("answer", F.when(said.isNull(), "?").otherwise(answer))
    return calls.comparisons(answers, ["lang"], ["length"]).drop("criterion")


@query("""WITH c(criterion, weight) AS (VALUES ('clarity', 1.0::DOUBLE), ('depth', 1.5::DOUBLE))
SELECT doc_id, criterion, weight, CASE WHEN (doc_id + length(criterion)) % 7 = 0 OR n_chars % 8 > 5 THEN NULL ELSE (n_chars % 8) / 5 END AS score FROM documents, c""")
def point_scores(spark, d):
    """Points of 0 to 5 for each criterion; answers out of shape or range score nothing."""
    docs = table(spark, d, "documents")
    plan = calls.score_calls(docs, ["doc_id", "n_chars"], "text", [("clarity", 1.0, "Is it clear?"), ("depth", 1.5, "Is it deep?")])
    answer = F.to_json(F.struct(F.array(F.struct("criterion", F.lit("").alias("reason"), (F.col("n_chars") % 8).cast("int").alias("score"))).alias("scores")))
    answers = plan.withColumn("answer", F.when((F.col("doc_id") + F.length("criterion")) % 7 == 0, "{}").otherwise(answer))
    return calls.scores(answers, ["doc_id"])


@query("""WITH a AS (SELECT doc_id, j, (doc_id + j) % 5 AS r FROM documents, (SELECT unnest(range(0, 3)) AS j)), v AS (SELECT doc_id, 2 * count(*) FILTER (r <= 2) > 3 AS bad FROM a GROUP BY 1),
k AS (SELECT DISTINCT doc_id, CASE r WHEN 0 THEN 'label_mismatch::' WHEN 1 THEN 'missing_head:head:' ELSE 'off_task_members::a,b' END AS s, r FROM a WHERE r <= 2),
g AS (SELECT doc_id, string_agg(s, '|' ORDER BY list_position(['label_mismatch', 'off_task_members', 'missing_head'], split_part(s, ':', 1))) AS s FROM k GROUP BY 1),
c AS (SELECT doc_id, string_agg('j' || j || '/form: o' || r, '|' ORDER BY j) FILTER (r <> 0) AS s FROM a GROUP BY 1)
SELECT v.doc_id, CASE WHEN bad THEN 'fail' ELSE 'pass' END AS verdict, coalesce(c.s, '') AS critiques, CASE WHEN bad THEN g.s ELSE '' END AS defects FROM v LEFT JOIN g ON g.doc_id = v.doc_id LEFT JOIN c ON c.doc_id = v.doc_id""")
def review_verdicts(spark, d):
    """Reviews by three judges: majority, critiques with their judges, defects of the failing ones once each."""
    plan = calls.review_calls(table(spark, d, "documents"), ["doc_id"], "text", "lang", ["j0", "j1", "j2"])
    r = (F.col("doc_id") + F.substring("judge", 2, 1).cast("long")) % 5
    kind = "array<struct<kind:string,members:array<string>,position:string>>"
    defects = F.when(r == 1, F.from_json(F.lit('[{"kind":"missing_head","position":"head","members":null}]'), kind)).when(r == 2, F.from_json(F.lit('[{"kind":"off_task_members","members":["b","a"],"position":null}]'), kind))
    said = F.struct(F.array(F.struct(F.lit("form").alias("aspect"), F.concat(F.lit("o"), r.cast("string")).alias("opinion"))).alias("critiques"), defects.alias("defects"), F.when(r <= 2, "fail").otherwise("pass").alias("verdict"))
    answers = plan.withColumn("answer", F.when(r == 0, "I can't say").otherwise(F.to_json(said)))
    out = calls.reviews(answers, ["doc_id"])
    return out.select("doc_id", "verdict", F.array_join("critiques", "|").alias("critiques"), F.array_join("defects", "|").alias("defects"))


@query("""SELECT doc_id, i AS place, 'text ' || doc_id || ' ' || i AS text FROM documents, (SELECT unnest(range(0, 3)) AS i) WHERE doc_id % 4 <> 1 AND doc_id % 4 <> 3""")
def grown_samples(spark, d):
    """Samples of answers; calls with another number of texts, or none, are void."""
    n = F.when(F.col("doc_id") % 4 == 1, 2).otherwise(3)
    texts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("text "), F.col("doc_id").cast("string"), F.lit(" "), i.cast("string")))
    answers = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 3, "no").otherwise(F.to_json(F.struct(texts.alias("samples")))).alias("answer"))
    return calls.samples(answers, ["doc_id"], 3).withColumn("place", F.col("place").cast("long"))


@query("""WITH m AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS seq, (row_number() OVER (ORDER BY doc_id) - 1) // 64 + 1 AS batch_no FROM documents),
g AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS k FROM conversations)
SELECT seq, batch_no, 'given' AS origin FROM m UNION ALL SELECT (SELECT count(*) FROM m) + k, (SELECT max(batch_no) FROM m) + (k - 1) // 64 + 1, 'grown' FROM g""")
def reentered(spark, d):
    """Grown records behind the given ones, in batches of their own."""
    from millrace.sources.jsonl import batches

    given = batches(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], 64)
    grown = table(spark, d, "conversations").select(F.col("conv_id").alias("call_index"), F.col("turn").alias("place"))
    return calls.reentered(given, grown, 64).select("seq", "batch_no", "origin")


@query(f"""WITH {_POS}, b AS (SELECT user_id, pos AS a, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS z FROM f), g AS (SELECT user_id, pos AS a, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS z FROM f WHERE event_id % 3 <> 0)
SELECT user_id, g.a AS "left", g.z AS "right" FROM g WHERE z IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = g.user_id AND b.a = g.a AND b.z = g.z)""")
def affected_pairs(spark, d):
    """Neighbours that come about when every third frame goes."""
    rows = _frames(spark, d)
    return calls.affected_pairs(rows, rows.where("event_id % 3 <> 0"), "user_id", "pos").select("user_id", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))


@query(f"WITH {_POS} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS idx FROM f WHERE event_id % 3 <> 0")
def renumbered_steps(spark, d):
    rows = calls.renumbered(_frames(spark, d).where("event_id % 3 <> 0"), "user_id", "pos")
    return rows.select("user_id", "event_id", F.col("idx").cast("long").alias("idx"))


@query("""WITH c AS (SELECT o_orderpriority AS profile, o_custkey % 500 AS p, o_orderkey % 90 AS o FROM orders)
SELECT profile, count(*) AS calls, sum(p)::BIGINT AS prompt_tokens, sum(o)::BIGINT AS output_tokens FROM c GROUP BY GROUPING SETS ((profile), ())""")
def token_usage(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("profile"), (F.col("o_custkey") % 500).alias("prompt_tokens"), (F.col("o_orderkey") % 90).alias("output_tokens"))
    return calls.token_usage(rows, ["profile"])


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 40)::INT AS f, (o_custkey % 900)::INT AS px, (o_orderkey % 20000)::INT AS budget FROM orders),
l AS (SELECT *, greatest(2, ceil(f / 2))::INT AS half, least(round(px * 1.5), 1200)::INT AS up FROM o)
SELECT o_orderkey, half AS frames, CASE WHEN px > 0 AND up > px AND 500 + half * ceil(least(ceil(up / 28) ** 2, 1568) * 1.2) <= budget THEN up END AS px FROM l""")
def repair_ladders(spark, d):
    """What a repaired answer is shown: half the frames, half as large again where the budget allows."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("f"), (F.col("o_custkey") % 900).cast("int").alias("px"), (F.col("o_orderkey") % 20000).alias("b"))
    step = calls.repair_ladder(F.col("f"), F.col("px"), F.lit(1200), F.col("b"), F.lit(500), F.lit("patch"))
    return o.select("o_orderkey", step.alias("s")).select("o_orderkey", "s.frames", "s.px")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
g AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY user_id ORDER BY pos) > 40000 OR step > 400 THEN 1 ELSE 0 END AS brk FROM e),
r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM g),
h AS (SELECT user_id, pos, run, k, k AS first_key, 1 AS len, 1 AS s, 'start' AS began FROM r WHERE pos = 1
  UNION ALL SELECT r.user_id, r.pos, r.run, r.k, CASE WHEN r.run <> h.run OR h.len = 8 OR r.k - h.first_key > 60000 THEN r.k ELSE h.first_key END,
    CASE WHEN r.run <> h.run OR h.len = 8 OR r.k - h.first_key > 60000 THEN 1 ELSE h.len + 1 END, CASE WHEN r.run <> h.run OR h.len = 8 OR r.k - h.first_key > 60000 THEN h.s + 1 ELSE h.s END,
    CASE WHEN r.run <> h.run THEN 'gap' WHEN h.len = 8 THEN 'max_len' WHEN r.k - h.first_key > 60000 THEN 'max_span' ELSE h.began END
  FROM h JOIN r ON r.user_id = h.user_id AND r.pos = h.pos + 1),
z AS (SELECT h.user_id, h.s, min(r.event_id) AS first_seq, max(r.event_id) AS last_seq, count(*) AS len, arg_min(h.began, h.pos) AS began FROM h JOIN r ON r.user_id = h.user_id AND r.pos = h.pos GROUP BY 1, 2)
SELECT user_id, first_seq, last_seq, len, CASE WHEN len = 8 THEN 'max_len' ELSE coalesce(lead(began) OVER (PARTITION BY user_id ORDER BY s), 'eof') END AS cause FROM z""")
def span_sessions(spark, d):
    """Sessions that also close at long steps and beyond a span."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("k"))
    out = sessions.sessions(rows, ["user_id"], "event_id", "k", "event_type", gap_s=40000, max_len=8, step="event_id", gap_steps=400, max_span_s=60000)
    return out.select("user_id", "first_seq", "last_seq", "len", "cause")


@query("""WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey, 1 + (c_custkey * 7919) % 90 AS n FROM customer),
w AS (SELECT i, c_custkey, n, n AS filled, c_custkey AS first FROM s WHERE i = 1
  UNION ALL SELECT s.i, s.c_custkey, s.n, CASE WHEN w.filled + s.n > 64 THEN s.n ELSE w.filled + s.n END, CASE WHEN w.filled + s.n > 64 THEN s.c_custkey ELSE w.first END FROM w JOIN s ON s.i = w.i + 1)
SELECT c_custkey, n, first FROM w""")
def session_batches(spark, d):
    """Whole sessions packed into batches in order; longer ones are batches of their own."""
    rows = table(spark, d, "customer").select("c_custkey", (1 + (F.col("c_custkey") * 7919) % 90).alias("n"))
    return chains.next_fit(rows, "c_custkey", "n", 64)


@query("""WITH l AS (SELECT l_orderkey, list(greatest(1, l_quantity::INT) ORDER BY l_linenumber, l_quantity) AS lens, sum(greatest(1, l_quantity::INT)) AS n, count(*) AS m FROM lineitem GROUP BY 1),
e AS (SELECT l_orderkey, lens, n, m, unnest(range(0, m)) AS i FROM l WHERE n > 12 AND m > 1 AND m <= 12),
q AS (SELECT *, lens[i + 1] AS len, (lens[i + 1] - 1) * (12 - m) // (n - m) AS base, (lens[i + 1] - 1) * (12 - m) % (n - m) AS rest FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, i) AS k, 12 - m - sum(base) OVER (PARTITION BY l_orderkey) AS spare, coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM q),
g AS (SELECT *, 1 + base + (k <= spare)::INT AS quota FROM r),
p AS (SELECT l_orderkey, begun + unnest(CASE WHEN quota = 1 THEN [CASE WHEN i = m - 1 THEN len - 1 ELSE 0 END] ELSE list_transform(range(0, quota::BIGINT), lambda j: j * (len - 1) // (quota - 1)) END) AS frame FROM g)
SELECT l_orderkey, frame::BIGINT AS frame FROM p
UNION ALL SELECT l_orderkey, unnest(CASE WHEN n <= 12 THEN range(0, n::BIGINT) ELSE list_transform(range(0, 12), lambda i: i * (n::BIGINT - 1) // 11) END) FROM l WHERE NOT (n > 12 AND m > 1 AND m <= 12)""")
def thread_keyframes(spark, d):
    """Keyframes of threads, each fragment with its share; the lines of an order are the fragments of a thread."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.greatest(F.lit(1), F.col("l_quantity").cast("int")).alias("n")))), lambda x: x["n"]).alias("lens"))  # seven lines at most
    frames = lines.select("l_orderkey", F.explode(text_fn.fragment_keyframes(F.col("lens"), 12)).alias("frame"))
    return frames.withColumn("frame", F.col("frame").cast("long"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'there' WHEN 1 THEN 'null' ELSE 'missing' END AS state, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR END AS value FROM events""")
def lookups(spark, d):
    """Missing, null and given values of a nested field."""
    k = F.col("event_id") % 3
    raw = F.concat(F.lit('{"a": {'), F.when(k == 0, F.concat(F.lit('"b": '), F.col("event_id").cast("string"))).when(k == 1, '"b": null').otherwise('"c": 1'), F.lit("}}"))
    return table(spark, d, "events").select("event_id", text_fn.lookup(raw, "a.b").alias("l")).select("event_id", "l.state", "l.value")


@query("SELECT event_id, replace(props, ' ', '') AS canonical FROM events")
def canonical_json(spark, d):
    return table(spark, d, "events").select("event_id", shapes.canonical_column(F.col("props")).alias("canonical"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS digest FROM documents""")
def normalized_texts(spark, d):
    """Texts as they are compared: NFC, white space as single blanks, none around."""
    return table(spark, d, "documents").select("doc_id", F.sha2(text_fn.normalized(F.col("text")), 256).alias("digest"))


@query("""WITH n AS (SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS h FROM documents),
k AS (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY h) AS again FROM n)
SELECT CASE WHEN again THEN 'exact' ELSE 'unique' END AS kind, count(*) AS n, count(DISTINCT CASE WHEN again THEN substr(h, 1, 16) END) AS clusters FROM k GROUP BY 1""")
def dedup_counts(spark, d):
    """Rows of each kind and the clusters among the copies."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(text_fn.normalized(F.coalesce("text", F.lit(""))), 256).alias("digest"))
    kinds = dedup.exact(written(docs, "digests"), "doc_id", F.col("digest"), "doc_id")
    return kinds.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("kind") != "unique", F.col("cluster_key"))).alias("clusters"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS t, o_custkey % 2 AS i, o_orderkey % 7 = 0 AS bad, ['both', 'tree', 'image'][1 + o_custkey % 3] AS req FROM orders),
h AS (SELECT *, t = 0 AS by_tree, i = 1 AS by_image FROM o)
SELECT o_orderkey, CASE WHEN NOT CASE WHEN bad THEN by_tree ELSE CASE req WHEN 'both' THEN by_tree AND by_image WHEN 'tree' THEN by_tree ELSE by_image END END THEN 'unique'
WHEN by_tree AND by_image AND NOT bad THEN 'near_both' WHEN by_tree THEN 'near_text' ELSE 'near_image' END AS kind FROM h""")
def composed_verdicts(spark, d):
    """Verdicts of tree and picture together, by what a project requires."""
    o = table(spark, d, "orders")
    tree, image, bad = F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 2 == 1, F.col("o_orderkey") % 7 == 0
    each = {r: dedup.composed(tree, image, r, bad) for r in ("both", "tree", "image")}
    kind = F.when(F.col("o_custkey") % 3 == 0, each["both"]).when(F.col("o_custkey") % 3 == 1, each["tree"]).otherwise(each["image"])
    return o.select("o_orderkey", kind.alias("kind"))


@query("SELECT d.lang, d.source, count(*) AS produced, count(*) FILTER (quality = 1) AS survived, count(*) FILTER (quality <> 1) AS rejected FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL")
def bucket_counts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return generate.bucket_stats(rows, ["lang", "source"], "good")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 2 = c_nationkey % 2 AS a, c_custkey % 3 = c_nationkey % 3 AS e, c_custkey % 5 IN (c_nationkey % 5, 1) AS p FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN a THEN 'app_overlap' END, CASE WHEN e THEN 'entity_overlap' END, CASE WHEN p THEN 'same_page' END) AS legs FROM c""")
def prior_legs(spark, d):
    """Which mechanical grounds two episodes share."""
    c = table(spark, d, "customer")
    text = lambda col, n: (F.col(col) % n).cast("string")
    legs = stitch.prior_legs(F.array(text("c_custkey", 2)), F.array(text("c_nationkey", 2)), F.array(text("c_custkey", 3)), F.array(text("c_nationkey", 3)), F.array(text("c_nationkey", 5), F.lit("1")), text("c_custkey", 5))
    return c.select("c_custkey", F.array_join(legs, ",").alias("legs"))


_DEFECTS = "['" + "', '".join(votes.DEFECTS) + "']"


@query(f"""WITH o AS (SELECT o_orderkey, {_DEFECTS}[1 + o_orderkey % 6] AS kind, o_custkey % 5 = 0 AS split, o_custkey % 7 = 0 AS clone FROM orders)
SELECT o_orderkey, CASE WHEN (split OR clone) AND kind <> 'label_mismatch' THEN 'mark' WHEN kind = 'label_mismatch' THEN 'reannotate' WHEN kind = 'off_task_members' THEN 'shrink' WHEN kind LIKE 'missing%' THEN 'reclaim' ELSE 'mark' END AS route,
CASE (o_orderkey % 4) WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' WHEN 2 THEN 'b' ELSE 'a,b' END AS members FROM o""")
def defect_routes(spark, d):
    """What follows from each defect, and members after shrinking (never none)."""
    o = table(spark, d, "orders")
    kind = F.get(F.array(*[F.lit(k) for k in votes.DEFECTS]), (F.col("o_orderkey") % 6).cast("int"))
    off = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("b"))).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("a"), F.lit("b"))).when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("z")))
    left = F.array_join(review.shrunk(F.array(F.lit("a"), F.lit("b")), off), ",")
    return o.select("o_orderkey", review.defect_route(kind, F.col("o_custkey") % 5 == 0, F.col("o_custkey") % 7 == 0).alias("route"), left.alias("members"))


@query("""WITH o AS (SELECT o_orderkey, '[' || (o_orderkey % 90 - 30) || ',' || o_custkey || '][' || (o_orderkey % 70) || ', 9]' AS good, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 3 THEN '0,0,0,0' ELSE (o_orderkey % 90 - 30) || ',' || (regexp_extract(good, ',(\\d+)\\]', 1)) || ',' || (o_orderkey % 70) || ',9' END AS box, k <> 1 AND k <> 2 AS visible FROM o""")
def screen_fields(spark, d):
    """Bounds given as text, and what counts as visible."""
    k = F.col("o_orderkey") % 4
    good = F.format_string("[%d,%d][%d, 9]", F.col("o_orderkey") % 90 - 30, F.col("o_custkey"), F.col("o_orderkey") % 70)
    seen = F.when(k == 0, "yes").when(k == 1, " FALSE ").when(k == 2, "").otherwise(None)
    box = text_fn.bounds(F.when(k == 3, "[1,2]").otherwise(good))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(box, lambda x: x.cast("string")), ",").alias("box"), text_fn.visible(seen).alias("visible"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 300 AS a, o_orderkey % 400 AS b, o_orderkey % 5 AS images, CASE WHEN o_custkey % 2 = 0 THEN 50 END AS schema_ FROM orders)
SELECT o_orderkey, (a + b + images * 79 + 4 * 2 + coalesce(schema_, 0))::BIGINT AS tokens, greatest(0, floor((b * 20 - a) / (400 + 128 + ceil(79 * 1.2))))::BIGINT AS frames FROM o""")
def prompt_sizes(spark, d):
    """Tokens of prompts from their parts, and the frames that always fit a window."""
    a, b = F.col("o_custkey") % 300, F.col("o_orderkey") % 400
    schema = F.when(F.col("o_custkey") % 2 == 0, 50)
    tokens = fit.prompt_tokens(F.array(a.cast("long"), b.cast("long")), F.col("o_orderkey") % 5, F.lit(79), F.lit(2), schema)
    return table(spark, d, "orders").select("o_orderkey", tokens.cast("long").alias("tokens"), fit.least_window(b * 20, a, 400, F.lit(79)).cast("long").alias("frames"))


@query("""WITH c AS (SELECT l_orderkey % 200 AS batch, l_quantity::DOUBLE AS cost FROM lineitem), p AS (SELECT batch, max(cost) AS m, count(*) AS n FROM c GROUP BY 1),
s AS (SELECT batch, sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, max(m) OVER (ORDER BY batch ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS top FROM p)
SELECT batch, CASE WHEN coalesce(seen, 0) >= 8 THEN ceil(top / 0.85) ELSE ceil(1568 * 1.2) END::BIGINT AS image_cost FROM s""")
def image_costs(spark, d):
    """Cost of a picture, calibrated on the batches before."""
    costs = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("batch"), F.col("l_quantity").cast("double").alias("cost"))
    return fit.calibrated_image_cost(costs, "batch", "cost", 1568).withColumn("image_cost", F.col("image_cost").cast("long"))


@query(f"""WITH k AS (SELECT {_DEFECTS}[1 + l_partkey % 4] AS kind FROM lineitem) SELECT x AS kind, (SELECT count(*) FROM k WHERE kind = x) AS n FROM (SELECT unnest({_DEFECTS}) AS x)""")
def defect_histogram(spark, d):
    """Count of each kind of defect, absent ones with 0."""
    kinds = F.array(*[F.lit(k) for k in votes.DEFECTS])
    return votes.zero_based(table(spark, d, "lineitem").select(F.get(kinds, (F.col("l_partkey") % 4).cast("int")).alias("kind")), "kind", list(votes.DEFECTS))


def _screens(spark, d):
    """A conversation's turns as the nodes of a screen, before and after its third turn."""
    c = table(spark, d, "conversations")
    node = F.struct(F.col("turn").cast("string").alias("node_id"), (F.col("turn") % 3).cast("int").alias("depth"), F.col("role"), F.substring(F.regexp_replace("text", "\\s+", " "), 1, 12).alias("text"), F.lit("").alias("content_desc"),
        F.array(F.lit(0), (F.length("text") % 40).cast("int"), F.lit(9), F.lit(9)).alias("bounds"), (F.col("turn") % 5 != 4).alias("visible"))
    whole = lambda x: x["n"].withField("extra", F.create_map(F.lit("package"), x["n"]["role"]))
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))), whole).alias("after"))  # a conversation's turns
    return rows.withColumn("before", F.filter("after", lambda n: n["node_id"].cast("int") < 3))


_NODES = "n AS (SELECT conv_id, turn, role, (turn % 3)::INT AS depth, substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 12) AS t, length(text) % 40 AS b FROM conversations WHERE turn % 5 <> 4)"


@query(f"""WITH {_NODES} SELECT conv_id, string_agg(repeat('  ', depth) || role || CASE WHEN t <> '' THEN ' "' || t || '"' ELSE '' END || ' [0,' || (b // 4) || ',2,2] package=' || role, chr(10) ORDER BY turn) AS line FROM n GROUP BY 1""")
def screen_lines(spark, d):
    """Screens as text, a line for each visible node, bounds quantised."""
    return _screens(spark, d).select("conv_id", ui.linear(F.col("after"), 4).alias("line")).where("line <> ''")


@query(f"""WITH {_NODES}, a AS (SELECT conv_id, role, depth, b // 4 AS q, t, count(*) FILTER (turn < 3) AS x, count(*) AS y FROM n GROUP BY ALL),
p AS (SELECT conv_id, role, depth, q, sum(x) AS x, sum(y) AS y, sum(least(x, y)) AS same FROM a GROUP BY ALL),
g AS (SELECT conv_id, sum(y - least(x, y))::BIGINT AS added, sum(x - least(x, y))::BIGINT AS removed, sum(least(x, y) - same)::BIGINT AS text_changed, sum(x) AS sx, sum(y) AS sy FROM p GROUP BY 1)
SELECT c.conv_id, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(text_changed, 0) AS text_changed, round((coalesce(added, 0) + coalesce(removed, 0) + coalesce(text_changed, 0)) / greatest(1, coalesce(sx, 0), coalesce(sy, 0)), 9) AS change_ratio
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id = c.conv_id""")
def screen_changes(spark, d):
    """Differences of a screen to the one before it."""
    out = ui.diff(_screens(spark, d), ["conv_id"], "before", "after")
    return out.withColumn("change_ratio", F.round("change_ratio", 9))


@query(f"""WITH {_NODES}, e AS (SELECT conv_id, t, min(turn) AS k FROM n WHERE t <> '' GROUP BY ALL) SELECT conv_id, string_agg(t, '|' ORDER BY k) AS entities FROM e GROUP BY 1""")
def screen_entities(spark, d):
    """What a screen names, each once, in order."""
    return _screens(spark, d).select("conv_id", F.array_join(ui.entities(F.col("after")), "|").alias("entities")).where("entities <> ''")


@query(f"""WITH {_NODES}, a AS (SELECT conv_id, arg_min(role, turn) AS app, arg_min(t, turn) FILTER (t <> '') AS title, count(*) AS n FROM n GROUP BY 1)
SELECT conv_id, app, CASE WHEN conv_id % 2 = 0 THEN app || '|w' || conv_id || '|' || coalesce(title, '-') END AS page FROM a""")
def screen_pages(spark, d):
    """The app of each screen, and its page where an activity is known."""
    own = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("w"), F.col("conv_id").cast("string"))).otherwise("")
    named = _screens(spark, d).withColumn("after", F.transform("after", lambda n: n.withField("extra", F.map_concat(n["extra"], F.create_map(F.lit("activity"), own)))))
    app = ui.apps(named, ["conv_id"], "after").where("size(apps) > 0").select("conv_id", F.element_at("apps", 1).alias("app"))
    told = F.from_json(ui.page(F.col("after")), "array<string>")
    page = F.when(told.isNotNull(), F.array_join(F.transform(told, lambda x: F.coalesce(x, F.lit("-"))), "|"))
    return app.join(named.select("conv_id", page.alias("page")), "conv_id")


@query("""SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(30) ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def sequence_texts(spark, d):
    """Texts of sequences as they are compared, before normalisation."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("m"))  # a conversation's turns
    return c.select("conv_id", F.sha2(text_fn.sequence_text(F.col("m")), 256).alias("digest"))


@query()
def image_dedup(spark, d):
    """Pictures whose 64-bit codes (signs of the embeddings here) lie within 8 bits of a kept earlier one."""
    bit = lambda i: F.when(F.get("embedding", i) >= 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = sum((bit(i) for i in range(1, 64)), bit(0))
    return dedup.near_image(table(spark, d, "embeddings").select("vec_id", code.alias("code")), "vec_id", "code")


@query()
def picture_dedup(spark, d):
    """Every document drawn as a picture, and its perceptual code against all kept earlier ones; distance is in bits."""
    from millrace.functions import picture

    coded = table(spark, d, "documents").select("doc_id", picture.coded(picture.drawn(F.col("text"))).alias("_c")).select("doc_id", "_c.code")
    coded = Written(coded, "picture-codes").df
    near = dedup.near_image(coded, "doc_id", "code").select(F.col("later").alias("doc_id"), F.col("earlier").alias("kept_id"), F.col("similarity").cast("int").alias("distance"))
    return coded.join(near, "doc_id", "left").select("doc_id", "code", F.when(F.col("kept_id").isNull(), "unique").otherwise("near_image").alias("kind"), "kept_id", "distance")
