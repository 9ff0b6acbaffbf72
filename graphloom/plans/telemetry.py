"""Plans over calls, accesses and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.measures import cost, redact, seconds
from graphloom.operators.telemetry import percentile, usage_rollup
from graphloom.plans.registry import query
from graphloom.sources.tables import Tables, with_derived

NOW = "2024-06-01"


_REASON = "'reason' || CAST(event_id % 9 AS STRING)"


@query("agg-16", with_derived(f", d AS (SELECT {_REASON} AS reason, count(*) AS n FROM usage WHERE NOT ok GROUP BY 1) SELECT 'allowed' AS what, count(*) FILTER (WHERE ok) AS n, NULL::DOUBLE AS rate FROM usage UNION ALL SELECT 'denied', count(*) FILTER (WHERE NOT ok), round(count(*) FILTER (WHERE NOT ok) / count(*)::DOUBLE, 6) FROM usage UNION ALL SELECT reason, n, NULL FROM (SELECT * FROM d ORDER BY n DESC, reason LIMIT 5)", "usage"))
def access_metrics(t: Tables) -> DataFrame:
    """Allowed and denied, the share of the denied, and the five most frequent reasons."""
    denied = F.count_if(~F.col("ok"))
    one = t.usage.agg(F.count_if("ok").alias("a"), denied.alias("d"), F.round(denied / F.count("*"), 6).alias("r"))
    total = one.select(F.explode(F.array(F.struct(F.lit("allowed").alias("what"), F.col("a").alias("n"), F.lit(None).cast("double").alias("rate")), F.struct(F.lit("denied").alias("what"), F.col("d").alias("n"), F.col("r").alias("rate")))).alias("x")).select("x.*")
    reasons = t.usage.where("NOT ok").groupBy(F.concat(F.lit("reason"), (F.col("event_id") % 9).cast("string")).alias("what")).agg(F.count("*").alias("n"))
    return total.union(reasons.orderBy(F.desc("n"), "what").limit(5).select("what", "n", F.lit(None).cast("double")))


@query("agg-17", with_derived("SELECT coalesce(tool, 'all') AS tool, count(*) AS n, count(*) FILTER (WHERE ok = false) AS errors, CASE WHEN tool IS NULL THEN round(count(*) FILTER (WHERE ok = false) / count(*)::DOUBLE, 6) END AS error_rate FROM usage GROUP BY ROLLUP (tool)", "usage"))
def usage_metrics(t: Tables) -> DataFrame:
    """Calls and errors by tool, and of all with the rate of errors."""
    errors = F.count_if(F.col("ok") == F.lit(False))
    rolled = t.usage.rollup("tool").agg(F.grouping("tool").alias("g"), F.count("*").alias("n"), errors.alias("errors"), F.round(errors / F.count("*"), 6).alias("rate"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("tool")).alias("tool"), "n", "errors", F.when(F.col("g") == 1, F.col("rate")).alias("error_rate"))


@query("agg-18", "SELECT count(*) AS n FROM events WHERE event_type = 'view'")
def recall_metrics(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'view'").agg(F.count("*").alias("n"))


@query("agg-20", with_derived("SELECT 'audit' AS source, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad FROM usage WHERE client = 'cli' UNION ALL SELECT 'mcp', count(*), count(*) FILTER (WHERE NOT ok) FROM usage UNION ALL SELECT 'recall', (SELECT count(*) FROM events WHERE event_type = 'view'), 0 UNION ALL SELECT 'reindex', 0, 0", "usage"))
def metrics_summary(t: Tables) -> DataFrame:
    """Totals of each source; one that is missing counts as empty."""
    one = lambda name, df: df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.coalesce(F.count_if(~F.col("ok")), F.lit(0)).alias("bad"))
    views, none = t.events.where("event_type = 'view'").select(F.lit(True).alias("ok")), t.usage.where("false")
    return one("audit", t.usage.where("client = 'cli'")).union(one("mcp", t.usage)).union(one("recall", views)).union(one("reindex", none))


_COST = "CASE model WHEN 'deepseek-chat' THEN cache_miss_tokens / 1e6 * 0.14::DOUBLE + cache_hit_tokens / 1e6 * 0.0028::DOUBLE + output_tokens / 1e6 * 0.28::DOUBLE WHEN 'deepseek-v4-pro' THEN cache_miss_tokens / 1e6 * 0.435::DOUBLE + cache_hit_tokens / 1e6 * 0.003625::DOUBLE + output_tokens / 1e6 * 0.87::DOUBLE ELSE 0 END"


@query("agg-24", with_derived(f"SELECT event_id, round({_COST}, 9) AS cost FROM usage", "usage"))
def cost_of_calls(t: Tables) -> DataFrame:
    return t.usage.select("event_id", F.round(cost(F.col("model"), F.col("cache_hit_tokens"), F.col("cache_miss_tokens"), F.col("output_tokens")), 9).alias("cost"))


_ROLL = f"SELECT CASE grouping_id(model, org_id, user_id) WHEN 7 THEN 'total' WHEN 3 THEN 'model' WHEN 5 THEN 'org' ELSE 'user' END AS level, model, org_id, user_id, count(*) AS queries, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_hit_tokens) AS BIGINT) AS cache_hit_tokens, CAST(sum(cache_miss_tokens) AS BIGINT) AS cache_miss_tokens, round(sum({_COST}), 6) AS cost, CASE WHEN sum(cache_hit_tokens + cache_miss_tokens) > 0 THEN round(CAST(sum(cache_hit_tokens) AS DOUBLE) / sum(cache_hit_tokens + cache_miss_tokens), 4) ELSE 0 END AS cache_hit_rate FROM usage {{}} GROUP BY GROUPING SETS ((), (model), (org_id), (user_id))"


def _rollup(df: DataFrame) -> DataFrame:
    return usage_rollup(df, cost(F.col("model"), F.col("cache_hit_tokens"), F.col("cache_miss_tokens"), F.col("output_tokens")))


@query("agg-21", with_derived(_ROLL.format(""), "usage"))
def rollup(t: Tables) -> DataFrame:
    return _rollup(t.usage)


@query("agg-22", with_derived("SELECT 'all' AS span, count(*) AS queries FROM usage UNION ALL SELECT 'last7d', count(*) FROM usage WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY", "usage"))
def usage_windows(t: Tables) -> DataFrame:
    latest = t.events.agg(F.max("ts").alias("m")).first()["m"]
    u = t.usage
    return u.agg(F.lit("all").alias("span"), F.count("*").alias("queries")).union(u.where(F.col("ts") >= F.lit(latest).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).agg(F.lit("last7d"), F.count("*")))


@query("agg-23", with_derived("SELECT org_id, count(*) AS queries, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM usage GROUP BY org_id", "usage"))
def usage_by_tenant(t: Tables) -> DataFrame:
    return t.usage.groupBy("org_id").agg(F.count("*").alias("queries"), F.sum("input_tokens").alias("input_tokens"))


def _nearest(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    at = lambda p: f"max(CASE WHEN i = CAST(round_even({p}::DOUBLE * (n - 1), 0) AS BIGINT) + 1 THEN round(elapsed_ms, 1) END)"
    return f"SELECT {keys + ', ' if keys else ''}{at(0.5)} AS p50, {at(0.95)} AS p95 FROM (SELECT *, row_number() OVER ({part} ORDER BY elapsed_ms) AS i, count(*) OVER ({part}) AS n FROM usage WHERE elapsed_ms IS NOT NULL) {'GROUP BY ' + keys if keys else ''}"


@query("agg-25", with_derived(_nearest("tool"), "usage"))
def latency_rollup(t: Tables) -> DataFrame:
    return percentile(t.usage, ["tool"], "elapsed_ms", {"p50": 0.5, "p95": 0.95})


@query("scl-30", with_derived(_nearest(""), "usage"))
def nearest_rank(t: Tables) -> DataFrame:
    return percentile(t.usage, [], "elapsed_ms", {"p50": 0.5, "p95": 0.95})


@query("agg-27", with_derived(f"SELECT tool, p95 <= 400 AS ok FROM ({_nearest('tool')})", "usage"))
def latency_gate(t: Tables) -> DataFrame:
    return percentile(t.usage, ["tool"], "elapsed_ms", {"p95": 0.95}).select("tool", (F.col("p95") <= 400).alias("ok"))


def _spans(name: str) -> str:
    return f"SELECT '{name}' AS span, tool, count(*) AS runs, round(count(*) FILTER (WHERE candidates > 0) / count(*)::DOUBLE, 4) AS hit_rate, " + ", ".join(f"max(CASE WHEN i = CAST(round_even({p}::DOUBLE * (n - 1), 0) AS BIGINT) + 1 THEN round(elapsed_ms, 1) END) AS {c}" for c, p in (("p50", 0.5), ("p95", 0.95))) + f" FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY elapsed_ms) AS i, count(*) OVER (PARTITION BY tool) AS n FROM usage WHERE elapsed_ms IS NOT NULL {'AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY' if name == 'last7d' else ''}) GROUP BY tool"


@query("agg-26", with_derived(f"{_spans('all')} UNION ALL {_spans('last7d')}", "usage"))
def latency_report(t: Tables) -> DataFrame:
    """Of all time and of the last seven days, by tool: runs, the share with results, and percentiles."""
    latest = t.events.agg(F.max("ts").alias("m")).first()["m"]
    u = t.usage.where("elapsed_ms IS NOT NULL")
    out = None
    for span, rows in {"all": u, "last7d": u.where(F.col("ts") >= F.lit(latest).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS"))}.items():
        runs = rows.groupBy("tool").agg(F.count("*").alias("runs"), F.round(F.count_if(F.col("candidates") > 0) / F.count("*"), 4).alias("hit_rate"))
        one = runs.join(percentile(rows, ["tool"], "elapsed_ms", {"p50": 0.5, "p95": 0.95}), "tool").select(F.lit(span).alias("span"), "tool", "runs", "hit_rate", "p50", "p95")
        out = one if out is None else out.union(one)
    return out


@query("agg-28", with_derived("SELECT project_id, tool, count(*) FILTER (WHERE client = 'cli') AS cli, count(*) FILTER (WHERE client = 'web') AS web, count(*) FILTER (WHERE client = 'ide') AS ide FROM usage GROUP BY ROLLUP (project_id, tool)", "usage"))
def usage_matrix(t: Tables) -> DataFrame:
    return t.usage.rollup("project_id", "tool").agg(*(F.count_if(F.col("client") == c).alias(c) for c in ("cli", "web", "ide")))


@query("agg-29", with_derived("SELECT coalesce(project_id, '(legacy)') AS project, count(*) AS n FROM usage WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1", "usage"))
def seven_days(t: Tables) -> DataFrame:
    latest = t.events.agg(F.max("ts").alias("m")).first()["m"]
    return t.usage.where(F.col("ts") >= F.lit(latest).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).groupBy(F.coalesce("project_id", F.lit("(legacy)")).alias("project")).agg(F.count("*").alias("n"))


@query("agg-31", with_derived("SELECT client, round(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*), 4) AS hit_rate, max(CASE WHEN i = CAST(floor(n / 2) AS BIGINT) + 1 THEN elapsed_ms END) AS upper_median FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY elapsed_ms) AS i, count(*) OVER (PARTITION BY client) AS n FROM usage WHERE elapsed_ms IS NOT NULL) GROUP BY client", "usage"))
def search_health(t: Tables) -> DataFrame:
    """The share of hits by client, and the upper median."""
    known = t.usage.where("elapsed_ms IS NOT NULL")
    rate = known.groupBy("client").agg(F.round(F.count_if("ok") / F.count("*"), 4).alias("hit_rate"))
    return rate.join(percentile(known, ["client"], "elapsed_ms", {"upper_median": lambda n: F.floor(n / 2) + 1}, places=None), "client").select("client", "hit_rate", "upper_median")


@query("agg-52", with_derived("SELECT tool, 'high latency' AS message FROM (" + _nearest("tool") + ") WHERE p95 > 100", "usage"))
def alerts(t: Tables) -> DataFrame:
    return percentile(t.usage, ["tool"], "elapsed_ms", {"p95": 0.95}).where("p95 > 100").select("tool", F.lit("high latency").alias("message"))


@query("flt-15", with_derived("SELECT event_id FROM usage WHERE project_id = 'p3' AND client = 'web' AND CAST(ts AS STRING) >= '2024-01-10'", "usage"))
def audit_predicate(t: Tables) -> DataFrame:
    return t.usage.where("project_id = 'p3' AND client = 'web'").where(F.date_format("ts", "yyyy-MM-dd HH:mm:ss") >= "2024-01-10").select("event_id")


@query("flt-16", "SELECT event_id FROM events WHERE event_id % 9 = 0 OR ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def within_since(t: Tables) -> DataFrame:
    """A time that cannot be parsed is kept."""
    latest = t.events.agg(F.max("ts").alias("m")).first()["m"]
    ts = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return t.events.where(ts.isNull() | (ts >= F.lit(latest).cast("timestamp_ntz") - F.expr("INTERVAL 3 DAYS"))).select("event_id")


@query("flt-30", "SELECT event_id, '<redacted:len=' || CAST(length(props) AS STRING) || ':' || substr(sha256(props), 1, 8) || '>' AS props FROM events")
def redaction(t: Tables) -> DataFrame:
    return t.events.select("event_id", redact(F.col("props")).alias("props"))


@query("src-15", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_lines(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.try_parse_json("props").alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'").select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("src-21", with_derived("SELECT event_id FROM (SELECT event_id, client FROM usage ORDER BY event_id DESC LIMIT 50000) WHERE client = 'web' ORDER BY event_id DESC LIMIT 20 OFFSET 40", "usage"))
def audit_page(t: Tables) -> DataFrame:
    latest = t.usage.orderBy(F.desc("event_id")).limit(50000).where("client = 'web'")
    return latest.orderBy(F.desc("event_id")).offset(40).limit(20).select("event_id")


@query("scl-26", "SELECT DISTINCT n_nationkey, CAST(n_nationkey + 1 AS DOUBLE) * CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END AS s FROM nation")
def durations(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, "smhd")), F.col("n_nationkey") % 4 + 1)
    return t.nation.select("n_nationkey", seconds(F.concat((F.col("n_nationkey") + 1).cast("string"), unit)).alias("s"))


@query("win-07", None)
def limiter(t: Tables) -> DataFrame:
    from graphloom.streaming.limiter import accepted

    return accepted(t.events.select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id"), 3, 86_400 * 1_000_000)
