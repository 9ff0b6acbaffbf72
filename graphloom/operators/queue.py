"""A queue of jobs as a table: what each command makes of its rows. A command takes the rows that it fits (a condition), and leaves others as they are; the table is read and written as versions of a store.

queue: id, project_id, kind; pending_at, pending_token, pending_meta of what is asked for; token, owner, claimed_at, lease_until, meta of what is under way; quarantined, quarantine_id; result, result_at, result_enqueued_at,
result_meta of what ended last. Metas are JSON objects. Rows that are set apart change by `release` only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.repos import numbered

#: The least step between two times.
STEP = 1e-6
FREE = {"token": None, "owner": None, "claimed_at": None, "lease_until": None, "meta": None}


def change(queue: DataFrame, condition: Column, **values) -> DataFrame:
    """The rows with a condition get new values, all from what they had before."""
    hit = F.coalesce(condition, F.lit(False))
    value = lambda c: c if isinstance(c, Column) else F.lit(c)
    return queue.select(*(F.when(hit, value(values[c])).otherwise(F.col(c)).cast(queue.schema[c].dataType).alias(c) if c in values else F.col(c) for c in queue.columns))


def live(now: float) -> Column:
    return F.coalesce(F.col("lease_until") > now, F.lit(False))


def enqueue(queue: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: project_id, kind, at. One pending entry a project and kind, with the last time; what is set apart stays so. queue: project_id, kind, pending_at, quarantined."""
    new = asked.groupBy("project_id", "kind").agg(F.max("at").alias("at"))
    met = queue.join(new, ["project_id", "kind"], "full")
    return met.select("project_id", "kind", F.coalesce("at", "pending_at").alias("pending_at"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"))


def eligible(now: float) -> Column:
    """Pending without a live claim, or claimed with a lease that is over; not set apart."""
    return ~F.col("quarantined") & ~live(now) & (F.col("pending_at").isNotNull() | F.col("token").isNotNull())


def claim(queue: DataFrame, now: float, lease: float, owner: str, projects: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The oldest eligible rows get a new token, an owner and a lease; what was pending is under way. One writer claims at a time."""
    wanted = eligible(now) & (F.col("project_id").isin(projects) if projects else F.lit(True))
    new = {"token": F.concat(F.lit("n"), F.col("id").cast("string")), "owner": owner, "claimed_at": now, "lease_until": now + lease, "pending_at": None, "pending_token": None, "meta": F.coalesce("pending_meta", "meta"), "pending_meta": None}
    if limit is None:
        return change(queue, wanted, **new)
    first = queue.where(wanted).orderBy(F.coalesce("pending_at", "claimed_at"), "id").limit(limit).select("id", F.lit(True).alias("_mine"))
    return change(queue.join(F.broadcast(first), "id", "left"), F.col("_mine"), **new).drop("_mine")


def held(token: Column, owner: Column) -> Column:
    """Claimed by that token and owner."""
    return (F.col("token") == token) & F.col("owner").eqNullSafe(owner)


def _open(condition: Column) -> Column:
    return condition & ~F.col("quarantined")


def _asked_again(since: Column, token: Column) -> dict[str, Column]:
    """A claim is pending again, unless something newer is."""
    none = F.col("pending_at").isNull()
    return {"pending_at": F.coalesce("pending_at", since), "pending_token": F.when(none, token).otherwise(F.col("pending_token")), "pending_meta": F.when(none, F.col("meta")).otherwise(F.col("pending_meta"))}


def _failed(reason: str, now: float) -> dict[str, Column | str | float | None]:
    """What ended a claim, with the reason in its meta."""
    meta = F.from_json(F.coalesce("meta", F.lit("{}")), "map<string,string>")
    merged = F.map_concat(F.map_filter(meta, lambda k, _: k != "failure_reason"), F.create_map(F.lit("failure_reason"), F.lit(reason)))
    return {"result": "failed", "result_at": now, "result_enqueued_at": F.col("claimed_at"), "result_meta": F.to_json(merged)} | FREE


def renew(queue: DataFrame, mine: Column, until: float) -> DataFrame:
    return change(queue, _open(mine), lease_until=until)


def retry(queue: DataFrame, mine: Column, now: float) -> DataFrame:
    """Given up claims are pending again behind all that is (but for what is set apart), one after another in the order of their ids; what was pending of the same row becomes that.
    A turn is counted in ranges of the ids, whatever the project."""
    last = queue.where("NOT quarantined").agg(F.greatest(F.coalesce(F.max("pending_at"), F.lit(now)), F.lit(now)).alias("_last"))
    ranked = numbered(queue.where(F.coalesce(_open(mine), F.lit(False))).select("id"), "id").select("id", (F.col("number") + 1).alias("_turn"))
    met = queue.crossJoin(F.broadcast(last)).join(ranked, "id", "left")  # last: one row
    new = _asked_again(F.lit(now), F.lit(None)) | {"pending_at": F.round(F.col("_last") + STEP * F.col("_turn"), 6), "pending_token": F.concat(F.lit("r"), F.col("id").cast("string"))}
    return change(met, F.col("_turn").isNotNull(), **new, **FREE).select(queue.columns)


def reject(queue: DataFrame, mine: Column, reason: str, now: float) -> DataFrame:
    """Failed, with the reason; what is pending since stays."""
    return change(queue, _open(mine), **_failed(reason, now))


def quarantine(queue: DataFrame, condition: Column, identity: Column) -> DataFrame:
    """Set apart under an identity; what is so already keeps its own."""
    return change(queue, condition & ~F.col("quarantined"), quarantined=True, quarantine_id=identity)


def release(queue: DataFrame, identity: str) -> DataFrame:
    """What was set apart under an identity is pending again since it was claimed, and its claim is free."""
    known = F.col("quarantined") & (F.col("quarantine_id") == identity)
    return change(queue, known, **_asked_again(F.col("claimed_at"), F.concat(F.lit("r"), F.col("id").cast("string"))), **FREE, quarantined=False, quarantine_id=None)


def publish_ack(queue: DataFrame, mine: Column, now: float) -> DataFrame:
    """Done; a newer pending entry stays."""
    return change(queue, _open(mine), **{"result": "done", "result_at": now, "result_enqueued_at": F.col("claimed_at"), "result_meta": F.col("meta")} | FREE)


def discard(queue: DataFrame, at: float, now: float) -> DataFrame:
    """What is pending no later than a time goes, and is told as the result; a claim runs on."""
    told = {"result": "discarded", "result_at": now, "result_enqueued_at": F.col("pending_at"), "result_meta": F.col("pending_meta")}
    return change(queue, _open(F.col("pending_at") <= at), pending_at=None, pending_token=None, pending_meta=None, **told)


def owned(queue: DataFrame, owner: str) -> DataFrame:
    """All claims of an owner, whether their leases are over or not, but for those set apart."""
    return queue.where(_open(F.col("token").isNotNull() & (F.col("owner") == owner)))


def reclaim(queue: DataFrame, owner: str) -> DataFrame:
    """The claims of a dead owner are pending again since they were claimed, unless something newer is."""
    return change(queue, _open(F.col("token").isNotNull() & (F.col("owner") == owner)), **_asked_again(F.col("claimed_at"), F.concat(F.lit("r"), F.col("id").cast("string"))), **FREE)


def reject_unowned(queue: DataFrame, now: float) -> DataFrame:
    """Claims of before there were owners fail when their lease is over."""
    return change(queue, _open(F.col("token").isNotNull() & F.col("owner").isNull() & F.coalesce(F.col("lease_until") < now, F.lit(False))), **_failed("legacy", now))


def migrate_pending(queue: DataFrame, expected: Column, token: Column) -> DataFrame:
    """The token of what is pending is replaced where it is the one that is expected."""
    return change(queue, F.col("pending_token") == expected, pending_token=token)


def gate(claims: DataFrame, queue: DataFrame, manifest: DataFrame) -> DataFrame:
    """claims: id, project_id, kind, commit, at; queue: project_id, pending_at, claimed_at of codegraph jobs; manifest: project_id, commit, status of codegraph builds. id, decision.

    ingest and code_vec wait for the codegraph build of the same commit: RUN when it succeeded, BLOCK when it failed and nothing newer is queued, else WAIT. Other kinds RUN."""
    newer = queue.groupBy("project_id").agg(F.max(F.greatest("pending_at", "claimed_at")).alias("newest"))
    met = claims.join(manifest.select("project_id", F.col("commit").alias("built"), "status"), "project_id", "left").join(newer, "project_id", "left")
    same = F.coalesce(F.col("built") == F.col("commit"), F.lit(False))
    busy = F.coalesce(F.col("newest") > F.col("at"), F.lit(False))
    decision = F.when(~F.col("kind").isin("ingest", "code_vec"), "RUN").when(same & (F.col("status") == "succeeded"), "RUN").when(same & (F.col("status") == "failed") & ~busy, "BLOCK").otherwise("WAIT")
    return met.select("id", decision.alias("decision"))


def summary(queue: DataFrame, now: float, stale: float = 300.0) -> DataFrame:
    """One row: counts by bucket, the age of the oldest pending entry, claims whose lease is over, keys both pending and claimed, the worst severity, and what to do."""
    pending, claimed = F.col("pending_at").isNotNull() & ~F.col("quarantined"), F.col("token").isNotNull() & ~F.col("quarantined")
    over = claimed & ~live(now)
    one = queue.agg(F.count_if(pending).alias("pending"), F.count_if(claimed).alias("active"), F.count_if("quarantined").alias("quarantined"), (F.lit(now) - F.min(F.when(pending, F.col("pending_at")))).alias("oldest"), F.count_if(over).alias("expired"), F.count_if(pending & claimed).alias("both"))
    worst = F.when((F.col("expired") > 0) | (F.col("quarantined") > 0), 2).when(F.coalesce(F.col("oldest") > stale, F.lit(False)), 1).otherwise(0)
    return one.withColumn("severity", worst).withColumn("action", F.when(F.col("expired") > 0, "reclaim").when(F.col("quarantined") > 0, "inspect").when(F.col("severity") == 1, "start_worker").otherwise("none"))
