"""Operators along lanes when one lane holds most rows and is cut into parts: against walks in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import lanes, sessions


@pytest.fixture(scope="module", autouse=True)
def uncoalesced(spark):
    """Small parts stay apart, so that lanes cross them."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def frames(n=1500, seed=1):
    rng = random.Random(seed)
    at, out = {}, []
    for k in range(n):
        lane = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
        at[lane] = at.get(lane, 0) + rng.choice([1, 1, 2, 5, 40])
        late = rng.choice([0] * 9 + [60])
        out.append((k, lane, float(at[lane] - late), rng.choice("xyz"), rng.choice(["u", "u", "u", "v", None])))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(frames(), "seq long, lane string, at double, what string, edge string").cache()


def by_lane(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_no_part_is_much_larger_than_the_others(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(-1)).alias("lane"), "id")
    parts = lanes.parted(rows, ["lane"], ["id"])
    sizes = sorted(r["count"] for r in parts.df.groupBy(lanes.PART).count().collect())
    assert len(sizes) >= 6 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    # what is read behind it is keyed by part and lane
    assert parts.df.groupBy(lanes.PART, lanes.LANE).count().agg(F.max("count")).first()[0] <= sizes[-1]


def test_scans(table):
    parts = lanes.parted(table, ["lane"], ["seq"]).df
    assert parts.where("lane = 'hot'").select(lanes.PART).distinct().count() > 3
    got = lanes.scan(parts, ["seq"], sums={"n": F.lit(1), "y": (F.col("what") == "y").cast("int")}, peaks={"peak": F.col("at")}, before={"prev": F.col("edge"), "prev_at": F.col("at")}, after={"next": F.col("seq")}, wholes={"most": (F.max, F.col("at")), "all": (F.sum, F.lit(1))})
    want = {}
    for own in by_lane(frames()).values():
        for k, r in enumerate(own):
            before = own[:k]
            want[r[0]] = (k + 1, sum(x[3] == "y" for x in own[: k + 1]), max((x[2] for x in before), default=None), before[-1][4] if before else None, before[-1][2] if before else None, own[k + 1][0] if k + 1 < len(own) else None, max(x[2] for x in own), len(own))
    assert {r["seq"]: (r["n"], r["y"], r["peak"], r["prev"], r["prev_at"], r["next"], r["most"], r["all"]) for r in got.collect()} == want


@pytest.mark.parametrize("first", [False, True])
def test_runs_and_totals(table, first):
    starts = (F.col("what") == "z") | (F.lit(first) & (F.col("seq") < 40))
    parts = lanes.parted(table, ["lane"], ["seq"]).df
    got = lanes.totals(lanes.runs(parts, ["seq"], starts, "run", "place"), ["run", "edge"], "same")
    want, groups = {}, {}
    for lane, own in by_lane(frames()).items():
        run = place = -1
        for k, r in enumerate(own):
            if k == 0 or r[3] == "z" or (first and r[0] < 40):
                run, place = run + 1, -1
            place += 1
            want[r[0]] = (run, place)
            groups.setdefault((lane, run, r[4]), []).append(r[0])
    same = {k: len(g) for g in groups.values() for k in g}
    assert {r["seq"]: (r["run"], r["place"], r["same"]) for r in got.collect()} == {k: (*v, same[k]) for k, v in want.items()}


def walked(rows, gap, most, span=0.0):
    """(lane, first, last, len, cause, sha) of each session."""
    out = []
    for lane, own in by_lane(rows).items():
        cut = [[own[0]]]
        why = []
        for prev, r in zip(own, own[1:]):
            moved = prev[4] is not None and prev[4] != r[4]
            began = "key" if moved else "gap" if r[2] - prev[2] > gap else None
            full = len(cut[-1]) == most
            over = span and r[2] - cut[-1][0][2] > span
            if began or full or over:
                why.append("max_len" if full else began or "max_span")
                cut.append([])
            cut[-1].append(r)
        last = "max_len" if len(cut[-1]) == most else "eof"
        for s, w in zip(cut, [*why, last], strict=True):
            out.append((lane, s[0][0], s[-1][0], len(s), w, hashlib.sha256("\n".join(x[3] for x in s).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("span", [0.0, 20.0])
def test_sessions(spark, span):
    rows = frames(seed=3)
    if span:  # order keys don't fall where spans are measured
        rows = [(k, lane, float(k), w, e) for k, lane, _, w, e in rows]
    df = spark.createDataFrame(rows, "seq long, lane string, at double, what string, edge string")
    got = sessions.sessions(df, ["lane"], "seq", "at", "what", boundary="edge", gap_s=30, max_len=6, max_span_s=span).collect()
    want = sorted(walked(rows, 30, 6, span), key=str)
    assert sorted(((r["lane"], r["first_seq"], r["last_seq"], r["len"], r["cause"]) for r in got), key=str) == sorted((w[:5] for w in want), key=str)
    ids = {}
    for _, first, _, _, _, sha in sorted(want, key=lambda w: w[1]):
        ids[first] = (sha[:16], sum(1 for w in want if w[5] == sha and w[1] < first))
    assert {r["first_seq"]: (r["session_id"], r["repeat"]) for r in got} == ids


def test_disorder(table):
    want = {}
    for own in by_lane(frames()).values():
        peak = float("-inf")
        for r in own:
            want[r[0]] = r[2] < peak
            peak = max(peak, r[2])
    assert {r["seq"]: r["late"] for r in sessions.in_order(table, ["lane"], "seq", "at").collect()} == want


@pytest.mark.parametrize("noise_filter", [True, False])
def test_segments(table, noise_filter):
    relation = F.when(F.col("what") == "x", "context_switch").when(F.col("edge") == "v", "interruption").when(F.col("edge").isNull(), None).otherwise("continues")
    got = sessions.segments(table.withColumn("relation", relation), "lane", "seq", "relation", 3, noise_filter)
    want = {}
    for own in by_lane(frames()).values():
        cut, noise = [], []
        for r in own:
            told = "context_switch" if r[3] == "x" else "interruption" if r[4] == "v" else None if r[4] is None else "continues"
            if noise_filter and told == "interruption":
                noise.append(r[0])
                continue
            if not cut or told == "context_switch":
                cut.append([])
            cut[-1].append(r[0])
        want |= {k: (None, None, "noise", "dropped_noise") for k in noise}
        for n, s in enumerate(cut):
            short = len(cut) > 1 and len(s) < 3
            want |= {k: (n, len(s), "below_min_len" if short else None, "dropped_noise" if short else "active") for k in s}
    assert {r["seq"]: (r["segment"], r["seg_len"], r["reason"], r["status"]) for r in got.collect()} == want


def test_pairs_seams_and_runs(table):
    own = by_lane(frames())
    got = {(r["lane"], r["idx"], r["prev"], r["curr"]) for r in sessions.adjacent_pairs(table, "lane", "seq", "what").collect()}
    assert got == {(lane, k, a[3], b[3]) for lane, rows in own.items() for k, (a, b) in enumerate(zip(rows, rows[1:]))}
    want = set()
    for lane, rows in own.items():
        for thread in "xyz":
            at = [k for k, r in enumerate(rows) if r[3] == thread]
            want |= {(lane, thread, rows[a][0], rows[b][0], b - a - 1) for a, b in zip(at, at[1:]) if b - a > 1}
    assert {tuple(r) for r in sessions.seams(table.select("lane", "what", "seq"), "lane", "what", "seq").collect()} == want
    noise = table.where("what = 'x'")
    want = set()
    for lane, rows in own.items():
        at = [r[0] for r in rows if r[3] == "x"]
        start = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] != at[k - 1] + 1:
                want.add((lane, at[start], at[k - 1], k - start))
                start = k
    assert {tuple(r) for r in sessions.rescue_runs(noise, "lane", "seq").collect()} == want


def test_empty_and_no_lane(spark, table):
    nothing = table.where("false")
    assert sessions.sessions(nothing, ["lane"], "seq", "at", "what", max_len=5).collect() == [] and sessions.in_order(nothing, ["lane"], "seq", "at").collect() == []
    assert [r["n"] for r in lanes.numbered(table, [], ["seq"], "n").orderBy("seq").collect()] == list(range(1, 1501))


def test_chains_send_no_table_through_the_driver(spark, capsys):
    """Every join of a chain shuffles both sides, however small its tables look on disk."""
    from millrace.operators import chains

    rows = spark.range(3000).select(F.col("id").alias("k"), (1 + F.col("id") * 7919 % 90).alias("n"))
    out = chains.next_fit(rows, "k", "n", 64)
    out.explain()
    assert "Broadcast" not in capsys.readouterr().out
    seen = []
    plain = type(rows).hint

    def hinted(self, name, *more):
        seen.append(name)
        return plain(self, name, *more)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows), "hint", hinted)
        reached = chains.chain(spark.range(100).select(F.lit(0).alias("p"), "id", (F.col("id") + 3).alias("to")), ["p"], "id", "to")
    assert len(seen) > 10 and set(seen) == {"merge"}
    assert sorted(r["id"] for r in reached.collect()) == list(range(0, 100, 3))
    want, first, filled = {}, None, 65
    for k in range(3000):
        n = 1 + k * 7919 % 90
        first, filled = (k, n) if filled + n > 64 else (first, filled + n)
        want[k] = first
    assert {r["k"]: r["first"] for r in out.collect()} == want
