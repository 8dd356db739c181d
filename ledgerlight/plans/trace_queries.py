"""Queries of traces, as-of joins, telemetry, usage and sinks over the driver's tables, each with its DuckDB SQL.

A user's events stand for spans: an event lasts as many minutes as its value says, and
its parent is the user's latest event before it of the level above (sign-up, view,
click or purchase, error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.operators import asof, serving, telemetry, traces
from ledgerlight.plans.reference_queries import table
from ledgerlight.sinks import snapshots, work_folder

_DAY = 86_400_000_000


def _day(c):
    return F.floor(c / _DAY)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 3).otherwise(2)
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", level.alias("level"), start.alias("start"), (start + F.round(F.col("value") * 100).cast("long") * 600_000).alias("end"))
    left = e.withColumn("_above", F.col("level") - 1)
    right = e.select("user_id", F.col("level").alias("_above"), "start", "event_id")
    met = asof.asof_join(left, right, ["user_id", "_above"], at="start", by="start", cell=_day, exact=False)
    return met.select(F.col("event_id").alias("span_id"), F.col("match.event_id").alias("parent_id"), "user_id", "event_type", "start", "end")


SPANS = """e AS (SELECT event_id, user_id, event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS level, epoch_us(ts) AS s, epoch_us(ts) + round(value * 100)::BIGINT * 600000 AS t FROM events),
spans AS (SELECT a.event_id AS span_id, b.event_id AS parent_id, a.event_type, a.s, a.t FROM e a ASOF LEFT JOIN e b ON a.user_id = b.user_id AND a.level - 1 = b.level AND a.s > b.s)"""


def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event: its root, its depth, and how many events, errors and microseconds hang below it."""
    spans = _spans(spark, sf_dir)
    return traces.rolled_up(spans, {"errors": (F.col("event_type") == "error").cast("long"), "micros": F.col("end") - F.col("start")})


ROLLUP_SQL = f"""WITH RECURSIVE {SPANS}, up AS (SELECT span_id, span_id AS above, parent_id AS next, 0::BIGINT AS depth FROM spans UNION ALL SELECT up.span_id, s.span_id, s.parent_id, depth + 1 FROM up JOIN spans s ON up.next = s.span_id),
below AS (SELECT above AS span_id, count(*) AS spans, count(*) FILTER (event_type = 'error') AS errors, sum(t - s)::BIGINT AS micros FROM up JOIN spans USING (span_id) GROUP BY above),
root AS (SELECT span_id, above AS root_id, depth FROM up WHERE next IS NULL)
SELECT span_id, root_id, depth, spans, errors, micros FROM below JOIN root USING (span_id)"""


def own_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event: how long it lasts, and how long without any of its children."""
    return traces.self_times(_spans(spark, sf_dir))


OWN_SQL = f"""WITH {SPANS}, kids AS (SELECT p.span_id, greatest(k.s, p.s) AS s, least(k.t, p.t) AS t FROM spans k JOIN spans p ON k.parent_id = p.span_id WHERE greatest(k.s, p.s) < least(k.t, p.t)),
seen AS (SELECT *, max(t) OVER (PARTITION BY span_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM kids),
c AS (SELECT span_id, sum(greatest(t - greatest(s, coalesce(reach, s)), 0))::BIGINT AS covered FROM seen GROUP BY span_id)
SELECT span_id, t - s AS total, t - s - coalesce(covered, 0) AS own FROM spans LEFT JOIN c USING (span_id)"""


def latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the user's latest purchase up to it."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    met = asof.asof_join(e.select("event_id", "user_id", "ts"), bought, ["user_id"], at="ts", by="ts", cell=_day)
    return met.select("event_id", "user_id", F.col("match.event_id").alias("purchase_id"), F.col("match.value").alias("purchase_value"))


BEFORE_SQL = """SELECT e.event_id, e.user_id, p.event_id AS purchase_id, p.value AS purchase_value FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts"""


def _marks(pages: DataFrame, mark: str) -> DataFrame:
    """Where ``mark`` begins in each page's html: page_id, at."""
    parts = pages.select("page_id", F.size(F.split("html", mark, -1)).alias("n"), F.posexplode(F.split("html", mark, -1)).alias("i", "part"))
    up_to = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.sum(F.char_length("part") + len(mark)).over(up_to) - len(mark)
    return parts.withColumn("at", at).filter("i < n - 1").select("page_id", "at")


def paragraph_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every start of a paragraph in a page with the first end of one at or after it: the bounds of sections as a table join."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    starts = _marks(pages, "<p>").select("page_id", (F.col("at") + 3).alias("start"))
    met = asof.asof_join(starts, _marks(pages, "</p>"), ["page_id"], at="start", by="at", cell=lambda c: F.floor(c / 65536), forward=True)
    return met.select("page_id", "start", F.col("match.at").alias("end"))


def _marks_sql(mark: str) -> str:
    return f"""SELECT page_id, sum(length(part) + {len(mark)}) OVER (PARTITION BY page_id ORDER BY i)::BIGINT - {len(mark)} AS at, i = n AS last FROM (SELECT page_id, unnest(string_split(html, '{mark}')) AS part, generate_subscripts(string_split(html, '{mark}'), 1) AS i, len(string_split(html, '{mark}')) AS n FROM pages)"""


BOUNDS_SQL = f"""WITH a AS ({_marks_sql("<p>")}), b AS ({_marks_sql("</p>")})
SELECT a.page_id, a.at + 3 AS start, b.at AS "end" FROM (SELECT * FROM a WHERE NOT last) a ASOF LEFT JOIN (SELECT * FROM b WHERE NOT last) b ON a.page_id = b.page_id AND a.at + 3 <= b.at"""


def telemetry_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an event of the application, with the fields that break its schema and the line that is logged."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turn_count"), F.max_by("role", "turn").alias("last"), F.min_by("text", "turn").alias("first"), F.count_if(F.col("role") == "assistant").alias("source_count"))
    event = F.when(F.col("last") == "assistant", "followup_completed").when(F.col("last") == "user", "followup_failed").otherwise(F.col("last"))
    events = c.select("conv_id", event.alias("event_type"), F.when(F.col("turn_count") > 2, "comparison").otherwise("single_company").alias("mode"), F.char_length("first").cast("long").alias("question_length"), "turn_count", "source_count", F.col("first").alias("error_type"))
    checked = telemetry.event_faults(events)
    line = telemetry.event_line(events.drop("error_type"))
    return checked.select("conv_id", F.array_join("faults", ",").alias("faults"), line.alias("line"))


TELEMETRY_SQL = """WITH c AS (SELECT conv_id, count(*) AS turn_count, arg_max(role, turn) AS last, arg_min(text, turn) AS first, count(*) FILTER (role = 'assistant') AS source_count FROM conversations GROUP BY conv_id),
v AS (SELECT *, CASE last WHEN 'assistant' THEN 'followup_completed' WHEN 'user' THEN 'followup_failed' ELSE last END AS event, CASE WHEN turn_count > 2 THEN 'comparison' ELSE 'single_company' END AS mode FROM c)
SELECT conv_id, concat_ws(',', CASE WHEN event IN ('followup_completed', 'followup_failed') THEN NULL ELSE 'event_type' END, CASE WHEN first IS NULL OR length(trim(first, ' ')) BETWEEN 1 AND 100 THEN NULL ELSE 'error_type' END) AS faults,
  '{"schema_version":1' || coalesce(',"event_type":"' || event || '"', '') || ',"mode":"' || mode || '"' || coalesce(',"question_length":' || length(first), '') || ',"turn_count":' || turn_count || ',"source_count":' || source_count || '}' AS line FROM v"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers of services that name their tokens differently, or say them badly: the first turns, the assistant's, short and long ones."""
    n, turn = F.char_length(F.coalesce("text", F.lit(""))), F.col("turn")
    two = lambda a, b: F.concat(F.lit('{"usage":{"' + a + '":'), n, F.lit(',"' + b + '":'), turn)
    total = F.concat(F.lit(',"total_tokens":'), n + turn)
    answer = (
        F.when(turn == 0, F.concat(two("prompt_tokens", "completion_tokens"), total, F.lit("}}")))
        .when((F.col("role") == "assistant") & (n < 300), F.concat(two("input_tokens", "output_tokens"), total, F.lit(',"cached":true}}')))
        .when(F.col("role") == "assistant", F.concat(two("prompt_tokens", "output_tokens"), F.lit(',"total_tokens":"'), n, F.lit('"}}')))
        .when(n < 200, F.concat(two("input_tokens", "output_tokens"), F.lit(',"prompt_tokens":-1'), total, F.lit("}}")))
        .when(turn < 4, F.lit('{"usage":null}'))
        .otherwise(F.concat(two("prompt_tokens", "completion_tokens"), F.lit("}}")))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))


ANSWERS = """a AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '{"usage":{"prompt_tokens":' || n || ',"completion_tokens":' || turn || ',"total_tokens":' || (n + turn) || '}}'
  WHEN role = 'assistant' AND n < 300 THEN '{"usage":{"input_tokens":' || n || ',"output_tokens":' || turn || ',"total_tokens":' || (n + turn) || ',"cached":true}}'
  WHEN role = 'assistant' THEN '{"usage":{"prompt_tokens":' || n || ',"output_tokens":' || turn || ',"total_tokens":"' || n || '"}}'
  WHEN n < 200 THEN '{"usage":{"input_tokens":' || n || ',"output_tokens":' || turn || ',"prompt_tokens":-1,"total_tokens":' || (n + turn) || '}}'
  WHEN turn < 4 THEN '{"usage":null}' ELSE '{"usage":{"prompt_tokens":' || n || ',"completion_tokens":' || turn || '}}' END AS j FROM (SELECT *, length(coalesce(text, '')) AS n FROM conversations)),
f AS (SELECT conv_id, turn, """ + ", ".join(f"CASE WHEN json_type(j, '$.usage.{n}') = 'UBIGINT' THEN json_extract(j, '$.usage.{n}')::BIGINT END AS {n}" for n in ("prompt_tokens", "input_tokens", "completion_tokens", "output_tokens", "total_tokens")) + """ FROM a),
g AS (SELECT conv_id, turn, coalesce(prompt_tokens, input_tokens) AS i, coalesce(completion_tokens, output_tokens) AS o, total_tokens AS t, CASE WHEN prompt_tokens IS NULL THEN 'input_tokens+' ELSE 'prompt_tokens+' END || CASE WHEN completion_tokens IS NULL THEN 'output_tokens' ELSE 'completion_tokens' END || '+total_tokens' AS rule FROM f),
u AS (SELECT conv_id, turn, CASE WHEN i + o + t IS NULL THEN 'unknown' ELSE rule END AS usage_rule, CASE WHEN i + o + t IS NOT NULL THEN i END AS input_tokens, CASE WHEN i + o + t IS NOT NULL THEN o END AS output_tokens, CASE WHEN i + o + t IS NOT NULL THEN t END AS total_tokens FROM g)"""


def answer_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that each answer says it used, and the rule by which it says so."""
    return telemetry.token_usage(_answers(spark, sf_dir), "answer").drop("answer", "usage_shape")


USAGE_SQL = f"WITH {ANSWERS} SELECT * FROM u"


def usage_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and tokens by rule, and by how many shapes of usage."""
    shapes = telemetry.usage_shapes(telemetry.token_usage(_answers(spark, sf_dir), "answer"))
    return shapes.groupBy("usage_rule").agg(F.sum("answers").alias("answers"), F.sum("tokens").alias("tokens"))


SHAPES_SQL = f"WITH {ANSWERS} SELECT usage_rule, count(*) AS answers, coalesce(sum(total_tokens), 0)::BIGINT AS tokens FROM u GROUP BY usage_rule"


def appended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended to one raw table in three runs, and what is read back of each."""
    orders, path = table(spark, sf_dir, "orders"), f"{work_folder(spark, 'runs')}/raw"
    kinds = {"high": F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), "none": F.col("o_orderpriority").startswith("4")}
    kinds["rest"] = ~F.coalesce(kinds["high"] | kinds["none"], F.lit(False))
    for run, rows in kinds.items():
        snapshots.append_run(orders.filter(rows), path, run)
    return spark.read.parquet(path).groupBy("ingestion_run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


RUNS_SQL = """SELECT CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '4%' THEN 'none' ELSE 'rest' END AS ingestion_run_id, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1"""


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second snapshot of the parts, without the dearest and with the small ones renamed, changes in the first."""
    part, root = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), work_folder(spark, "changes")
    later = part.filter("p_retailprice <= 1500").withColumn("p_name", F.when(F.col("p_size") < 5, F.upper("p_name")).otherwise(F.col("p_name")))
    numbers = [snapshots.publish(spark, root, snapshots.snapshot_id(rows, "p_partkey", "parts"), {"parts": rows}) for rows in (part, later)]
    return snapshots.changes(spark, root, "parts", *numbers).select("p_partkey", "p_name", "change")


CHANGES_SQL = """WITH later AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN upper(p_name) ELSE p_name END AS p_name, p_size, p_retailprice FROM part WHERE p_retailprice <= 1500), a AS (SELECT p_partkey, p_name, p_size, p_retailprice FROM part)
SELECT p_partkey, p_name, 'removed' AS change FROM (FROM a EXCEPT ALL FROM later) UNION ALL SELECT p_partkey, p_name, 'added' FROM (FROM later EXCEPT ALL FROM a)"""


def cited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as citations of parts, of which the larger ones were captured with their names."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("evidence_id"))
    kept = table(spark, sf_dir, "part").filter("p_size > 20").select(F.col("p_partkey").alias("evidence_id"), F.col("p_name").alias("evidence_text"))
    return serving.cited_evidence(cited, kept)


CITED_SQL = "SELECT l_orderkey AS finding_id, l_linenumber AS position, l_partkey AS evidence_id, p_name AS evidence_text, p_name IS NULL AS citation_only FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON l_partkey = p_partkey"


def citing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part the orders that cite it, in the order of their lines."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("evidence_id"))
    return serving.citing_findings(cited).select("evidence_id", F.array_join(F.col("findings").cast("array<string>"), ",").alias("findings"))


CITING_SQL = "WITH c AS (SELECT l_partkey, l_orderkey, min(l_linenumber) AS p FROM lineitem GROUP BY ALL) SELECT l_partkey AS evidence_id, string_agg(l_orderkey::VARCHAR, ',' ORDER BY p, l_orderkey) AS findings FROM c GROUP BY 1"


def covering_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events, and days of them, that every user has one of."""
    e = table(spark, sf_dir, "events")
    users = e.agg(F.count_distinct("user_id")).first()[0]
    kinds = e.select("user_id", F.explode(F.array("event_type", F.concat("event_type", F.lit(" on day "), F.dayofmonth("ts")))).alias("dimension"))
    return serving.covering_sections(kinds.withColumnRenamed("user_id", "symbol"), users)


COVERING_SQL = "WITH k AS (SELECT user_id, event_type AS dimension FROM events UNION ALL SELECT user_id, event_type || ' on day ' || day(ts) FROM events) SELECT dimension FROM k GROUP BY 1 HAVING count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events)"

#: name: (query, DuckDB SQL or None)
ALL = {
    "trace_rollup": (trace_rollup, ROLLUP_SQL),
    "own_times": (own_times, OWN_SQL),
    "latest_before": (latest_before, BEFORE_SQL),
    "paragraph_bounds": (paragraph_bounds, BOUNDS_SQL),
    "telemetry_faults": (telemetry_faults, TELEMETRY_SQL),
    "answer_usage": (answer_usage, USAGE_SQL),
    "usage_shapes": (usage_shapes, SHAPES_SQL),
    "appended_runs": (appended_runs, RUNS_SQL),
    "snapshot_changes": (snapshot_changes, CHANGES_SQL),
    "cited_parts": (cited_parts, CITED_SQL),
    "citing_orders": (citing_orders, CITING_SQL),
    "covering_types": (covering_types, COVERING_SQL),
}
