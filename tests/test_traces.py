"""As-of joins, traces, telemetry and usage against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import asof, telemetry, traces


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
def test_as_of_equals_search(spark, forward, exact):
    rng = random.Random(1)
    left = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice([None, rng.randint(-90, 90)])) for i in range(300)]
    right = [(rng.choice(["hot", "hot", "c", None]), rng.choice([None, rng.randint(-90, 90)]), rng.randint(0, 5), rng.choice([None, "x"])) for _ in range(120)]
    a, b = spark.createDataFrame(left, "i int, k string, v int"), spark.createDataFrame(right, "k string, w int, n int, s string")
    found = asof.asof_join(a, b, ["k"], at="v", by="w", cell=lambda c: F.floor(c / 7), forward=forward, exact=exact)
    assert found.columns == ["i", "k", "v", "match"]
    got = {r["i"]: tuple(r["match"]) if r["match"] else None for r in found.collect()}
    assert len(got) == 300
    for i, k, v in left:
        near = [x for x in right if k is not None and x[0] == k and v is not None and x[1] is not None and ((x[1] > v if forward else x[1] < v) or exact and x[1] == v)]
        at = (min if forward else max)((x[1] for x in near), default=None)
        wanted = min(((x[1], x[2], x[3]) for x in near if x[1] == at), key=lambda x: (x[1], x[2] is not None, x[2] or ""), default=None)
        assert got[i] == wanted


def test_as_of_of_empty_tables(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 2)], "k int, w int")
    join = lambda x, y: asof.asof_join(x, y, ["k"], at="v", by="w", cell=lambda c: c).collect()
    assert [tuple(r) for r in join(a, b.limit(0))] == [(1, 2, None)] and join(a.limit(0), b) == []


def test_as_of_forms_no_pairs(spark):
    a, b = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("v")), spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("w"))
    plan = asof.asof_join(a, b, ["k"], at="v", by="w", cell=lambda c: c)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def _forest(seed):
    rng = random.Random(seed)
    # A chain of 90, a star of 80, a random tree, and a span whose parent is unknown.
    parents = {i: i - 1 if i else None for i in range(90)} | {100 + i: 100 if i else None for i in range(80)} | {200 + i: 200 + rng.randrange(i) if i else 5 for i in range(80)} | {400: 999}
    rows = []
    for i, p in parents.items():
        start = rng.randint(0, 500)
        rows.append((i, p, start, start + rng.choice([0, 5, 40, 200]), rng.choice([None, rng.randint(-3, 9)])))
    return rows


def test_trees_roll_up(spark):
    rows = _forest(2)
    spans = spark.createDataFrame(rows, "span_id long, parent_id long, start long, end long, n int")
    got = {r["span_id"]: (r["root_id"], r["depth"], r["spans"], r["n"]) for r in traces.rolled_up(spans, {"n": F.col("n")}).collect()}
    parent, wanted = {r[0]: r[1] for r in rows}, {}
    sums = {i: [0, 0] for i in parent}
    for i, _, _, _, n in rows:
        at, depth = i, 0
        while True:
            sums[at][0] += 1
            sums[at][1] += n or 0
            if parent[at] not in parent:
                break
            at, depth = parent[at], depth + 1
        wanted[i] = (at, depth)
    assert got == {i: (*wanted[i], *sums[i]) for i in parent}


def test_circles_are_refused_and_empty_forests_are_empty(spark):
    schema = "span_id long, parent_id long, start long, end long"
    with pytest.raises(ValueError, match="circle"):
        traces.rolled_up(spark.createDataFrame([(1, 2, 0, 1), (2, 3, 0, 1), (3, 1, 0, 1), (4, None, 0, 1)], schema), {})
    none = spark.createDataFrame([], schema)
    assert traces.rolled_up(none, {}).collect() == [] and traces.self_times(none).collect() == []


@pytest.mark.parametrize("cell", [1, 16, 100_000])
def test_own_time_is_what_no_child_covers(spark, cell):
    rows = _forest(3)
    spans = spark.createDataFrame(rows, "span_id long, parent_id long, start long, end long, n int")
    got = {r["span_id"]: (r["total"], r["own"]) for r in traces.self_times(spans, cell).collect()}
    for i, _, start, end, _ in rows:
        held = {t for _, p, a, b, _ in rows if p == i for t in range(max(a, start), min(b, end))}
        assert got[i] == (end - start, end - start - len(held))


def test_summaries_hold_what_is_named_and_nothing_else(spark):
    spans = spark.createDataFrame([(1, "agent_run", {"app.model": "m", "secret": "s"}), (2, "other", {"app.model": "m"}), (3, None, None), (4, "tool_x", None)], "span_id long, name string, attributes map<string, string>")
    found = traces.span_summaries(spans, ["agent_", "tool_"], ["app.model", "app.topic"]).orderBy("span_id")
    assert found.columns == ["span_id", "name", "model", "topic"]
    assert [tuple(r) for r in found.collect()] == [(1, "agent_run", "m", None), (4, "tool_x", None, None)]


def test_events_follow_their_schema(spark):
    good = {"event_type": "research_completed", "mode": "comparison", "symbols": ["AB", "CD"], "evidence_count": 0, "market_window_sessions": 60, "limitation_present": False}
    cases = [
        (good, []),
        ({"event_type": "other"}, ["event_type"]),
        ({"event_type": None}, ["event_type"]),
        (good | {"mode": "x", "symbols": ["A", "B", "C"]}, ["mode", "symbols"]),
        (good | {"symbols": ["A", " "]}, ["symbols"]),
        (good | {"market_window_sessions": 0, "evidence_count": -1}, ["market_window_sessions", "evidence_count"]),
        (good | {"error_type": " ", "report_status": "x" * 101, "synthesis_mode": " " + "x" * 100}, ["report_status", "error_type"]),
        (good | {"feedback": "bad"}, ["feedback"]),
        ({"event_type": "feedback_submitted"}, ["feedback"]),
        ({"event_type": "feedback_submitted", "feedback": "helpful"}, []),
    ]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in telemetry.EVENT)
    events = spark.createDataFrame([(i, *[c.get(n) for n in telemetry.EVENT.names]) for i, (c, _) in enumerate(cases)], f"i int, {fields}")
    found = {r["i"]: sorted(r["faults"]) for r in telemetry.event_faults(events).collect()}
    assert found == {i: sorted(f) for i, (_, f) in enumerate(cases)}
    line = json.loads(events.filter("i = 0").select(telemetry.event_line(events).alias("x")).first()["x"])
    assert line == good | {"schema_version": 1}


def test_usage_is_read_by_shape(spark):
    cases = [
        ({"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}, (3, 4, 7)),
        ({"input_tokens": 3, "output_tokens": 0, "total_tokens": 3}, (3, 0, 3)),
        ({"prompt_tokens": -1, "input_tokens": 3, "output_tokens": 4, "total_tokens": 7}, (3, 4, 7)),
        ({"prompt_tokens": True, "input_tokens": 3, "output_tokens": 4, "total_tokens": 7}, (3, 4, 7)),
        ({"prompt_tokens": 1, "input_tokens": 3, "output_tokens": 4, "total_tokens": 7}, (1, 4, 7)),
        ({"prompt_tokens": "3", "completion_tokens": 4, "total_tokens": 7}, None),
        ({"prompt_tokens": 3.5, "completion_tokens": 4, "total_tokens": 7}, None),
        ({"prompt_tokens": 3, "completion_tokens": 4}, None),
        ({"prompt_tokens": 3, "completion_tokens": None, "total_tokens": 7}, None),
        ([1], None),
        (None, None),
    ]
    rows = [(i, json.dumps({"usage": u})) for i, (u, _) in enumerate(cases)] + [(50, "{"), (51, None), (52, "{}"), (53, '"usage"')]
    used = telemetry.token_usage(spark.createDataFrame(rows, "i int, answer string"), "answer")
    got = {r["i"]: (r["input_tokens"], r["output_tokens"], r["total_tokens"]) if r["usage_rule"] != "unknown" else None for r in used.collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)} | dict.fromkeys([50, 51, 52, 53])
    shapes = telemetry.usage_shapes(used).collect()
    assert sum(r["answers"] for r in shapes) == len(rows) and len({r["fingerprint"] for r in shapes}) == len({r["usage_shape"] for r in shapes})


def test_tasks_of_as_of_joins_and_own_times_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(asof, "TASK_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    # Values stand in the first cell only, so all later ones have it from cells before.
    met = asof.asof_join(rows, rows.filter("v < 3").withColumnRenamed("v", "w"), ["k"], at="v", by="w", cell=lambda c: F.floor(c / 7))
    assert met.rdd.getNumPartitions() == 11 and {r["match"]["w"] - r["k"] for r in met.collect()} == {0}
    spans = spark.range(500).select(F.col("id").alias("span_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"))
    own = traces.self_times(spans)
    assert own.rdd.getNumPartitions() == 20 and {r["own"] for r in own.filter("span_id < 499").collect()} == {1}
