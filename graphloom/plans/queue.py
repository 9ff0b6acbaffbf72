"""Plans of the job queue's commands at the time 1100: each returns what it changes of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import queue as ops
from graphloom.plans.registry import query
from graphloom.sources.tables import Tables, with_derived

NOW = 1100.0
_LIVE, _ELIGIBLE = "coalesce(lease_until > 1100, false)", "NOT quarantined AND NOT coalesce(lease_until > 1100, false) AND (pending_at IS NOT NULL OR token IS NOT NULL)"


def mine():
    """The claims of w1, by the right tokens for two of three."""
    return ops.held(F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("wrong"), F.lit("w1"))


_ENDED = "result, result_at, result_enqueued_at, result_meta, token, owner, claimed_at, lease_until, meta, pending_at"


def _updated(condition: str, values: str, columns: str) -> str:
    """SQL: rows with a condition get values (column = expression; NULL for free claims), all rows have the columns."""
    new = dict(x.split(" = ", 1) for x in values.split("; "))
    return "SELECT id, " + ", ".join(f"CASE WHEN {condition} THEN {new[c]} ELSE {c} END AS {c}" if c in new else c for c in columns.split(", ")) + " FROM queue"


_FREE = "token = NULL; owner = NULL; claimed_at = NULL; lease_until = NULL; meta = NULL"
_AGAIN = "pending_at = coalesce(pending_at, claimed_at); pending_token = CASE WHEN pending_at IS NULL THEN 'r' || CAST(id AS STRING) ELSE pending_token END; pending_meta = CASE WHEN pending_at IS NULL THEN meta ELSE pending_meta END"
_PENDING = "pending_at, pending_token, pending_meta, token, owner, claimed_at, lease_until, meta, quarantined, quarantine_id"
_MINE = "coalesce(token IS NOT NULL AND id % 3 > 0 AND owner = 'w1', false)"


@query("str-01", with_derived("SELECT project_id, kind, max(CASE WHEN id % 2 = 0 THEN 5000 + id % 700 END) IS NOT NULL AS asked, coalesce(max(CASE WHEN id % 2 = 0 THEN CAST(5000 + id % 700 AS DOUBLE) END), max(CASE WHEN id % 2 = 1 THEN pending_at END)) AS pending_at, coalesce(bool_or(quarantined) FILTER (WHERE id % 2 = 1), false) AS quarantined FROM queue GROUP BY project_id, kind HAVING count(*) FILTER (WHERE id % 2 = 0 OR id % 2 = 1) > 0", "queue").replace("max(CASE WHEN id % 2 = 0 THEN 5000 + id % 700 END) IS NOT NULL AS asked, ", ""))
def enqueue(t: Tables) -> DataFrame:
    """Asked for again, an entry is refreshed; what is set apart stays so."""
    q = t.queue
    there = q.where("id % 2 = 1").groupBy("project_id", "kind").agg(F.max("pending_at").alias("pending_at"), F.bool_or("quarantined").alias("quarantined"))
    return ops.enqueue(there, q.where("id % 2 = 0").select("project_id", "kind", (5000 + F.col("id") % 700).cast("double").alias("at")))


@query("str-02", with_derived(f", f AS (SELECT id FROM queue WHERE {_ELIGIBLE} AND project_id IN ('p1', 'p2', 'p3', 'p4', 'p5') ORDER BY coalesce(pending_at, claimed_at), id LIMIT 25) SELECT id, 'n' || CAST(id AS STRING) AS token, 'w9' AS owner, 1700.0::DOUBLE AS lease_until FROM f", "queue"))
def claim(t: Tables) -> DataFrame:
    done = ops.claim(t.queue, NOW, 600.0, "w9", [f"p{i}" for i in range(1, 6)], 25)
    return done.where("owner = 'w9'").select("id", "token", "owner", "lease_until")


@query("str-03", with_derived("SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY pending_at, id) AS place FROM queue WHERE pending_at IS NOT NULL AND NOT quarantined", "queue"))
def scan(t: Tables) -> DataFrame:
    """What is pending, in the order of time, project by project."""
    from pyspark.sql import Window

    return t.queue.where("pending_at IS NOT NULL AND NOT quarantined").select("id", F.row_number().over(Window.partitionBy("project_id").orderBy("pending_at", "id")).alias("place"))


@query("str-04", with_derived(f"SELECT id, CASE WHEN {_MINE} AND NOT quarantined THEN 2000.0::DOUBLE ELSE lease_until END AS lease_until FROM queue", "queue"))
def renew(t: Tables) -> DataFrame:
    return ops.renew(t.queue, mine(), 2000.0).select("id", "lease_until")


@query("str-05", with_derived(f""", k AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM queue WHERE {_MINE} AND NOT quarantined), z AS (SELECT greatest(max(pending_at), 1100) AS z FROM queue WHERE NOT quarantined)
SELECT q.id, coalesce(round(z + 0.000001::DOUBLE * k.n, 6), q.pending_at) AS pending_at, CASE WHEN k.id IS NOT NULL THEN 'r' || CAST(k.id AS STRING) ELSE q.pending_token END AS pending_token, CASE WHEN k.id IS NOT NULL AND q.pending_at IS NULL THEN q.meta ELSE q.pending_meta END AS pending_meta, CASE WHEN k.id IS NULL THEN q.token END AS token, CASE WHEN k.id IS NULL THEN q.meta END AS meta FROM queue q CROSS JOIN z LEFT JOIN k ON k.id = q.id""", "queue"))
def retry(t: Tables) -> DataFrame:
    return ops.retry(t.queue, mine(), NOW).select("id", "pending_at", "pending_token", "pending_meta", "token", "meta")

@query("str-06", with_derived(_updated(f"{_MINE} AND NOT quarantined", f"result = 'failed'; result_at = 1100; result_enqueued_at = claimed_at; result_meta = CAST(json_merge_patch(coalesce(meta, '{{}}')::JSON, '{{\"failure_reason\":\"broken\"}}'::JSON) AS VARCHAR); {_FREE}", _ENDED), "queue"))
def reject(t: Tables) -> DataFrame:
    return ops.reject(t.queue, mine(), "broken", NOW).select("id", *_ENDED.split(", "))

@query("str-07", with_derived("SELECT id, quarantined OR id % 7 = 0 AS quarantined, CASE WHEN quarantined THEN quarantine_id WHEN id % 7 = 0 THEN 'new' || CAST(id AS STRING) END AS quarantine_id FROM queue", "queue"))
def quarantine(t: Tables) -> DataFrame:
    return ops.quarantine(t.queue, F.col("id") % 7 == 0, F.concat(F.lit("new"), F.col("id").cast("string"))).select("id", "quarantined", "quarantine_id")


@query("str-08", with_derived(_updated("quarantined AND quarantine_id = 'q1'", f"{_AGAIN}; {_FREE}; quarantined = false; quarantine_id = NULL", _PENDING), "queue"))
def release(t: Tables) -> DataFrame:
    return ops.release(t.queue, "q1").select("id", *_PENDING.split(", "))

@query("str-10", with_derived(_updated(f"{_MINE} AND NOT quarantined", f"result = 'done'; result_at = 1100; result_enqueued_at = claimed_at; result_meta = meta; {_FREE}", _ENDED), "queue"))
def publish_ack(t: Tables) -> DataFrame:
    return ops.publish_ack(t.queue, mine(), NOW).select("id", *_ENDED.split(", "))

@query("str-11", with_derived(_updated("coalesce(pending_at <= 1200, false) AND NOT quarantined", "pending_at = NULL; result = 'discarded'; result_at = 1100; result_enqueued_at = pending_at; result_meta = pending_meta", _ENDED), "queue"))
def discard(t: Tables) -> DataFrame:
    return ops.discard(t.queue, 1200.0, NOW).select("id", *_ENDED.split(", "))

@query("str-12", with_derived(_updated("coalesce(owner = 'w0', false) AND token IS NOT NULL AND NOT quarantined", f"{_AGAIN}; {_FREE}", _PENDING), "queue"))
def reclaim(t: Tables) -> DataFrame:
    return ops.reclaim(t.queue, "w0").select("id", *_PENDING.split(", "))

@query("str-13", with_derived("SELECT id, token, claimed_at, lease_until, meta FROM queue WHERE owner = 'w1' AND token IS NOT NULL AND NOT quarantined", "queue"))
def recover(t: Tables) -> DataFrame:
    """The claims of an owner that has come back."""
    return ops.owned(t.queue, "w1").select("id", "token", "claimed_at", "lease_until", "meta")

@query("str-14", with_derived(f"SELECT project_id, bool_or(pending_at IS NOT NULL) AS pending, bool_or({_LIVE}) AS active, bool_or(quarantined) AS quarantined FROM queue WHERE kind = 'codegraph' GROUP BY project_id", "queue"))
def dependency_state(t: Tables) -> DataFrame:
    q = t.queue.where("kind = 'codegraph'")
    return q.groupBy("project_id").agg(F.bool_or(F.col("pending_at").isNotNull()).alias("pending"), F.bool_or(ops.live(NOW)).alias("active"), F.bool_or("quarantined").alias("quarantined"))


@query("str-15", with_derived(""", mf AS (SELECT 'p' || CAST(i AS STRING) AS project_id, 'c' || CAST(i % 4 AS STRING) AS built, ['succeeded', 'failed', 'running'][1 + i % 3] AS status FROM range(45) t(i)), nw AS (SELECT project_id, max(CASE WHEN pending_at IS NULL THEN claimed_at WHEN claimed_at IS NULL THEN pending_at ELSE greatest(pending_at, claimed_at) END) AS newest FROM queue WHERE kind = 'codegraph' AND id % 11 = 0 GROUP BY 1)
SELECT id, CASE WHEN kind <> 'ingest' THEN 'RUN' WHEN built = 'c' || CAST(id % 4 AS STRING) AND status = 'succeeded' THEN 'RUN' WHEN built = 'c' || CAST(id % 4 AS STRING) AND status = 'failed' AND NOT coalesce(newest > 1200, false) THEN 'BLOCK' ELSE 'WAIT' END AS decision FROM queue LEFT JOIN mf USING (project_id) LEFT JOIN nw USING (project_id)""", "queue"))
def dependency_gate(t: Tables) -> DataFrame:
    """Builds of 45 projects; a failed one blocks unless newer codegraph work is queued."""
    claims = t.queue.select("id", "project_id", "kind", F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("commit"), F.lit(1200.0).alias("at"))
    i = F.col("id")
    manifest = t.spark.range(45).select(F.concat(F.lit("p"), i.cast("string")).alias("project_id"), F.concat(F.lit("c"), (i % 4).cast("string")).alias("commit"), F.element_at(F.array(*map(F.lit, ("succeeded", "failed", "running"))), (i % 3 + 1).cast("int")).alias("status"))
    return ops.gate(claims, t.queue.where("kind = 'codegraph' AND id % 11 = 0"), manifest)


@query("str-25", with_derived(_updated("token IS NOT NULL AND owner IS NULL AND coalesce(lease_until < 1100, false) AND NOT quarantined", f"result = 'failed'; result_at = 1100; result_enqueued_at = claimed_at; result_meta = CAST(json_merge_patch(coalesce(meta, '{{}}')::JSON, '{{\"failure_reason\":\"legacy\"}}'::JSON) AS VARCHAR); {_FREE}", _ENDED), "queue"))
def legacy_reject(t: Tables) -> DataFrame:
    return ops.reject_unowned(t.queue, NOW).select("id", *_ENDED.split(", "))

@query("str-26", with_derived("SELECT id, CASE WHEN pending_token = 'm' || CAST(id - id % 2 AS STRING) THEN 'new' ELSE pending_token END AS pending_token FROM queue", "queue"))
def pending_migration(t: Tables) -> DataFrame:
    """Half of the expected tokens are wrong."""
    return ops.migrate_pending(t.queue, F.concat(F.lit("m"), (F.col("id") - F.col("id") % 2).cast("string")), F.lit("new")).select("id", "pending_token")


@query("agg-53", with_derived(f"SELECT count(*) FILTER (WHERE pending_at IS NOT NULL AND NOT quarantined) AS pending, count(*) FILTER (WHERE token IS NOT NULL AND NOT quarantined) AS active, count(*) FILTER (WHERE quarantined) AS quarantined, 1100 - min(CASE WHEN NOT quarantined THEN pending_at END) AS oldest, count(*) FILTER (WHERE token IS NOT NULL AND NOT quarantined AND NOT {_LIVE}) AS expired, count(*) FILTER (WHERE token IS NOT NULL AND pending_at IS NOT NULL AND NOT quarantined) AS both, 2 AS severity, 'reclaim' AS action FROM queue", "queue").replace(" AS both,", ' AS "both",'))
def queue_summary(t: Tables) -> DataFrame:
    return ops.summary(t.queue, NOW)


_TOKENS = "SELECT c_custkey AS id, md5(c_name) AS hash, c_custkey % 40 AS user_id, CASE WHEN c_custkey % 9 = 0 THEN 'EXPIRED' ELSE 'ACTIVE' END AS status FROM customer"


def _tokens(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.md5(F.col("c_name").cast("binary")).alias("hash"), (F.col("c_custkey") % 40).alias("user_id"), F.when(F.col("c_custkey") % 9 == 0, "EXPIRED").otherwise("ACTIVE").alias("status"))


@query("str-27", f"SELECT id, CASE WHEN status = 'ACTIVE' AND starts_with(hash, 'a1') THEN 'REVOKED' ELSE status END AS status FROM ({_TOKENS})")
def token_revoke(t: Tables) -> DataFrame:
    return ops.change(_tokens(t), (F.col("status") == "ACTIVE") & F.startswith("hash", F.lit("a1")), status="REVOKED").select("id", "status")


@query("str-28", f"SELECT id, CASE WHEN status = 'ACTIVE' AND user_id = 7 THEN 'REVOKED' ELSE status END AS status FROM ({_TOKENS})")
def user_revoke(t: Tables) -> DataFrame:
    return ops.change(_tokens(t), (F.col("status") == "ACTIVE") & (F.col("user_id") == 7), status="REVOKED").select("id", "status")


@query("str-19", with_derived("SELECT id, CASE WHEN id % 3 = 0 AND owner = 'u7' AND org_id = 'o1' AND NOT is_redline THEN 'forgotten' ELSE status END AS status FROM memories", "memories"))
def forget(t: Tables) -> DataFrame:
    """Entries that an owner forgets, of the own org, and no redlines."""
    return ops.change(t.memories, (F.col("id") % 3 == 0) & (F.col("owner") == "u7") & (F.col("org_id") == "o1") & ~F.col("is_redline"), status="forgotten").select("id", "status")


@query("str-21", with_derived("SELECT id, CASE WHEN task_id = 't3' AND status = 'active' AND org_id = 'o1' THEN 'done' END AS task_state FROM memories", "memories"))
def task_state(t: Tables) -> DataFrame:
    held = t.memories.withColumn("task_state", F.lit(None).cast("string"))
    return ops.change(held, (F.col("task_id") == "t3") & (F.col("status") == "active") & (F.col("org_id") == "o1"), task_state="done").select("id", "task_state")


@query("str-23", """WITH b AS (SELECT s_suppkey AS k, ['codegraph', 'ingest', 'code_vec'][1 + s_suppkey % 3] AS kind, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 20 END AS built, CASE WHEN s_suppkey % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN s_suppkey % 11 > 0 THEN 10 END AS head, s_suppkey % 4 > 0 AS graph_fresh FROM supplier)
SELECT k, CASE WHEN head IS NULL OR built IS NULL THEN NULL WHEN status = 'failed' THEN false WHEN NOT built >= head THEN false WHEN kind = 'code_vec' THEN graph_fresh ELSE true END AS fresh FROM b""")
def freshness(t: Tables) -> DataFrame:
    """A build is fresh if its commit is the head or comes after it, by a table of ancestors; that of vectors needs a fresh graph too. Nothing is known without a head or a commit."""
    k = F.col("s_suppkey")
    builds = t.supplier.select(k.alias("k"), F.element_at(F.array(*map(F.lit, ("codegraph", "ingest", "code_vec"))), (k % 3 + 1).cast("int")).alias("kind"), F.when(k % 7 > 0, k % 20).alias("built"), F.when(k % 5 == 0, "failed").otherwise("succeeded").alias("status"), F.when(k % 11 > 0, F.lit(10).cast("long")).alias("head"), (k % 4 > 0).alias("graph_fresh"))
    line = t.spark.range(20).select(F.col("id").alias("built"), F.explode(F.sequence(F.lit(0).cast("long"), "id")).alias("head")).withColumn("after", F.lit(True))
    met = builds.join(line, ["built", "head"], "left")
    after = F.coalesce("after", F.lit(False))
    return met.select("k", F.when(F.col("head").isNull() | F.col("built").isNull(), None).when(F.col("status") == "failed", False).when(~after, False).when(F.col("kind") == "code_vec", F.col("graph_fresh")).otherwise(True).alias("fresh"))
