"""Plans over stores, logs and indexes: what is written is read again from where it was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import chunks, strip
from graphloom.operators.memory import keyword_order, visible
from graphloom.operators.retrieval import bm25, cosine, rrf, text_index, top
from graphloom.operators.shared import cut, written
from graphloom.plans.memory import TERMS, scopes
from graphloom.plans.registry import query
from graphloom.plans.retrieval import _NOTES, notes
from graphloom.sources.log import CommitLog
from graphloom.sources.store import PART, GraphStore, publish_builds
from graphloom.sources.tables import Tables, with_derived
from graphloom.streaming.pushes import COMMITS, lines, pushes
from graphloom.streaming.sinks import TwoSinks, settled


@query("src-01", with_derived("SELECT 'node' AS what, id, NULL AS target, row_number() OVER (ORDER BY id, ord) AS place FROM store_nodes WHERE project_id = 'p1' AND plugin = 'sql' UNION ALL SELECT 'edge', source, target, row_number() OVER (ORDER BY source, target, kind, ord) FROM store_edges WHERE project_id = 'p1' AND plugin = 'sql'", "store_nodes", "store_edges"))
def graph_scan(t: Tables) -> DataFrame:
    """Nodes and edges of one plugin of a project, in their order; other partitions are not read."""
    store = GraphStore.temporary(t.spark)
    store.replace("nodes", t.store_nodes.select("project_id", "plugin", "id", "ord"), ["id", "ord"], part=PART)
    store.replace("edges", t.store_edges.select("project_id", "plugin", "source", "target", "kind", "ord"), ["source", "target", "kind", "ord"], part=PART)
    mine = "project_id = 'p1' AND plugin = 'sql'"
    place = lambda *c: F.row_number().over(Window.partitionBy("project_id").orderBy(*c)).alias("place")
    nodes = store.read("nodes").where(mine).select(F.lit("node").alias("what"), "id", F.lit(None).cast("string").alias("target"), place("id", "ord"))
    return nodes.union(store.read("edges").where(mine).select(F.lit("edge"), "source", "target", place("source", "target", "kind", "ord")))


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, plugin, id ORDER BY ord DESC) AS rn FROM store_nodes WHERE NOT (project_id = 'p2' AND plugin = 'vue' AND ord % 3 > 0)) WHERE rn = 1"


@query("src-03", with_derived(f"SELECT project_id, plugin, id, kind FROM ({_LAST})", "store_nodes"))
def replace_by_plugin(t: Tables) -> DataFrame:
    """A second result of one plugin of one project takes the place of its first; in one result the last of equal ids stays."""
    store = GraphStore.temporary(t.spark)
    store.replace("nodes", t.store_nodes, ["id"], part=PART)
    store.replace("nodes", t.store_nodes.where("project_id = 'p2' AND plugin = 'vue' AND ord % 3 = 0"), ["id"], part=PART)
    return store.read("nodes").select("project_id", "plugin", "id", "kind")


@query("src-06", with_derived("SELECT what, plugin, CASE WHEN what = 'nodes' AND plugin = 'vue' THEN NULL ELSE n END AS n, n AS ingested FROM (SELECT 'nodes' AS what, plugin, count(DISTINCT id) AS n FROM store_nodes WHERE project_id = 'p1' GROUP BY plugin UNION ALL SELECT 'edges', plugin, count(*) FROM (SELECT DISTINCT plugin, source, target, kind, ord FROM store_edges WHERE project_id = 'p1') GROUP BY plugin)", "store_nodes", "store_edges"))
def store_stats(t: Tables) -> DataFrame:
    """Rows of a project's tables by plugin, and what was recorded when they were ingested; one plugin's nodes are gone since."""
    store = GraphStore.temporary(t.spark)
    store.ingest("nodes", t.store_nodes.where("project_id = 'p1'"), ["id"])
    store.ingest("edges", t.store_edges.where("project_id = 'p1'"), ["source", "target", "kind", "ord"])
    store.clear("nodes", [{"project_id": "p1", "plugin": "vue"}])
    now = [store.read(table).groupBy(F.lit(table).alias("what"), F.col("plugin").cast("string").alias("plugin")).agg(F.count("*").alias("n")) for table in ("nodes", "edges")]
    return store.ingested().where("project_id = 'p1'").select("what", "plugin", "ingested").join(now[0].union(now[1]), ["what", "plugin"], "left").select("what", "plugin", "n", "ingested")


@query("src-07", with_derived("SELECT project_id, row_number() OVER (ORDER BY project_id) AS place FROM (SELECT DISTINCT project_id FROM store_nodes)", "store_nodes"))
def list_projects(t: Tables) -> DataFrame:
    found = t.store_nodes.select("project_id").distinct()
    return found.select("project_id", F.row_number().over(Window.orderBy("project_id")).alias("place"))  # one row a project


@query("src-08", with_derived("SELECT id, CASE WHEN ord % 2 = 0 THEN project_id ELSE 'legacy' END AS project_id FROM store_nodes", "store_nodes"))
def migration(t: Tables) -> DataFrame:
    """Rows of before there were projects get the one that they are migrated to; others keep theirs."""
    old = t.store_nodes.where("ord % 2 = 1").select("id")
    return t.store_nodes.where("ord % 2 = 0").select("id", "project_id").unionByName(old, allowMissingColumns=True).withColumn("project_id", F.coalesce("project_id", F.lit("legacy")))


@query("lin-36", with_derived("SELECT project_id, plugin, count(*) AS n FROM store_nodes WHERE plugin <> 'scan' GROUP BY ALL", "store_nodes"))
def stale_clear(t: Tables) -> DataFrame:
    """Rows of a plugin that does not apply any more go, in all projects."""
    store = GraphStore.temporary(t.spark)
    store.replace("nodes", t.store_nodes, ["id", "ord"], part=PART)
    held = store.read("nodes").select(*PART).distinct()
    store.clear("nodes", [r.asDict() for r in held.where("plugin = 'scan'").collect()])  # a row a project
    return store.read("nodes").groupBy(*PART).agg(F.count("*").alias("n"))


@query("lin-37", with_derived("SELECT plugin, count(*) AS n FROM store_nodes WHERE plugin = 'vue' OR ord % 2 = 0 GROUP BY plugin", "store_nodes"))
def failure_guard(t: Tables) -> DataFrame:
    """New results replace old ones, but not those of a plugin that has failed in any repository."""
    store = GraphStore.temporary(t.spark)
    store.replace("nodes", t.store_nodes, ["id", "ord"])
    failed = t.spark.createDataFrame([("r1", "vue")], "repo string, plugin string")
    store.replace("nodes", t.store_nodes.where("ord % 2 = 0").join(F.broadcast(failed), "plugin", "left_anti"), ["id", "ord"])
    return store.read("nodes").groupBy("plugin").agg(F.count("*").alias("n"))


@query("src-13", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 < 2 THEN '中文 ' || s_name END AS text, CASE s_suppkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gbk' ELSE 'skipped' END AS how FROM supplier")
def text_decode(t: Tables) -> DataFrame:
    """UTF-8, else GBK, else skipped: one small function over batches of bytes."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, content in zip(pdf["k"], pdf["content"], strict=True):
                text, how = None, "skipped"
                for name in ("utf-8", "gbk"):
                    try:
                        text, how = bytes(content).decode(name), name
                        break
                    except UnicodeDecodeError:
                        continue
                out.append((k, text, how))
            yield pd.DataFrame(out, columns=["k", "text", "how"])

    name = F.col("s_name").cast("binary")
    start = F.when(F.col("s_suppkey") % 3 == 0, F.encode(F.lit("中文 "), "UTF-8")).when(F.col("s_suppkey") % 3 == 1, F.unhex(F.lit("D6D0CEC420"))).otherwise(F.unhex(F.lit("FFFF20")))
    return t.supplier.select(F.col("s_suppkey").alias("k"), F.concat(start, name).alias("content")).mapInPandas(run, "k long, text string, how string")


def _lines(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    """Lines of JSON with some that are none, written and read as text."""
    store = GraphStore.temporary(t.spark)
    bad = rows.limit(3).select(F.lit("{ broken").alias("value")).union(rows.limit(1).select(F.lit("[1]")))
    rows.select(F.to_json(F.struct("*")).alias("value")).union(bad).write.text(f"{store.folder}/{name}")
    return t.spark.read.text(f"{store.folder}/{name}").select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")


@query("src-16", "SELECT event_id, event_type AS query, value AS total_ms FROM events WHERE event_type <> 'error'")
def recall_traces(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_type") == "error", "other").otherwise("recall").alias("event"), F.col("event_type").alias("query"), F.col("value").alias("total_ms"))
    get = lambda k, kind: F.try_variant_get("v", f"$.{k}", kind)
    return _lines(t, rows, "recall").where(get("event", "string") == "recall").select(get("event_id", "bigint").alias("event_id"), get("query", "string").alias("query"), get("total_ms", "double").alias("total_ms"))


@query("src-17", "SELECT event_id, event_id % 400 AS input_tokens FROM events WHERE event_id % 3 = 0")
def agent_traces(t: Tables) -> DataFrame:
    """Ends of runs that tell what was used."""
    usage = F.when(F.col("event_id") % 3 != 1, F.struct((F.col("event_id") % 400).alias("input_tokens")))
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 == 2, "step").otherwise("done").alias("event"), usage.alias("usage"))
    get = lambda k, kind: F.try_variant_get("v", f"$.{k}", kind)
    return _lines(t, rows, "agent").where((get("event", "string") == "done") & get("usage.input_tokens", "bigint").isNotNull()).select(get("event_id", "bigint").alias("event_id"), get("usage.input_tokens", "bigint").alias("input_tokens"))


def _log(t: Tables) -> DataFrame:
    """A log of builds, a file a nation: of each supplier a header, its projects and its scopes."""
    k = F.col("s_suppkey")
    projects = F.array_join(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string"))), ", ")
    lines = F.array(F.concat(F.lit("===== reindex started at "), k.cast("string"), F.lit(" =====")), F.lit("noise: a, b"), F.concat(F.lit("projects: "), projects), F.concat(F.lit("scopes: "), F.when(k % 2 == 0, "ingest,code_vec").otherwise(" chroma , ")))
    return t.supplier.select(F.col("s_nationkey").alias("file"), k.alias("k"), F.posexplode(lines).alias("i", "line")).select("file", (F.col("k") * 10 + F.col("i")).alias("no"), "line")


def blocks(log: DataFrame) -> DataFrame:
    """log: file, no, line. file, id, started, projects, scopes: a header opens a record; the lists of a record's lines, without blanks."""
    header = F.regexp_extract("line", r"^===== reindex started at (.*) =====$", 1)
    marked = log.withColumn("h", F.nullif(header, F.lit(""))).withColumn("id", F.count("h").over(Window.partitionBy("file").orderBy("no"))).where("id > 0")
    items = lambda name: F.filter(F.transform(F.split(F.regexp_extract("line", rf"^{name}:\s*(.*)$", 1), ","), strip), lambda x: x != "")
    held = marked.groupBy("file", "id").agg(F.max("h").alias("started"), *(F.flatten(F.collect_list(items(n))).alias(n) for n in ("projects", "scopes")))
    return held


@query("win-09", "SELECT s_nationkey AS file, s_suppkey * 10 + i AS no, row_number() OVER (PARTITION BY s_nationkey, i ORDER BY s_suppkey) AS id FROM supplier, range(4) t(i)")
def block_ids(t: Tables) -> DataFrame:
    header = F.startswith("line", F.lit("===== reindex started at ")).cast("int")
    return _log(t).select("file", "no", F.sum(header).over(Window.partitionBy("file").orderBy("no")).alias("id"))


@query("src-18", "SELECT s_nationkey AS file, CAST(s_suppkey AS STRING) AS started, array_to_string(['p' || CAST(i AS STRING) FOR i IN range(0, s_suppkey % 4 + 1)], ',') AS projects, CASE WHEN s_suppkey % 2 = 0 THEN 'ingest,code_vec' ELSE 'chroma' END AS scopes, s_suppkey % 4 + 1 AS fan_out FROM supplier")
def log_blocks(t: Tables) -> DataFrame:
    return blocks(_log(t)).select("file", "started", F.array_join("projects", ",").alias("projects"), F.array_join("scopes", ",").alias("scopes"), F.size("projects").cast("long").alias("fan_out"))


@query("agg-19", "SELECT 'runs' AS what, count(*) FILTER (WHERE s_suppkey % 4 > 0) AS n FROM supplier UNION ALL SELECT 'most', max(s_suppkey % 4 + 1) FROM supplier UNION ALL SELECT 'scope:ingest', count(*) FILTER (WHERE s_suppkey % 2 = 0) FROM supplier UNION ALL SELECT 'scope:code_vec', count(*) FILTER (WHERE s_suppkey % 2 = 0) FROM supplier UNION ALL SELECT 'scope:chroma', count(*) FILTER (WHERE s_suppkey % 2 = 1) FROM supplier")
def reindex_metrics(t: Tables) -> DataFrame:
    found = blocks(_log(t))
    runs = found.agg(F.count_if(F.size("projects") > 1).alias("runs"), F.max(F.size("projects")).cast("long").alias("most"))
    scope = found.select(F.explode("scopes").alias("s")).groupBy(F.concat(F.lit("scope:"), "s").alias("what")).agg(F.count("*").alias("n"))
    return runs.select(F.expr("stack(2, 'runs', runs, 'most', most) AS (what, n)")).union(scope)


@query("src-19", "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY 1")
def trace_sink(t: Tables) -> DataFrame:
    """Traces that arrive as a stream, in two runs from one checkpoint, lie by batch in one sink and their days in another."""
    store = GraphStore.temporary(t.spark)
    rows = t.events.where("event_id % 10 = 0").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    for part in ("event_id % 20 = 0", "event_id % 20 > 0"):
        store.append("arrived", rows.where(part))
        sinks = TwoSinks(t.spark, f"{store.folder}/traces", lambda entries: entries.select("event_id", "day"))
        sinks.drain(t.spark.readStream.schema("event_id long, day string").json(f"{store.folder}/arrived"))
    return sinks.read("made", "event_id long, day string").groupBy("day").agg(F.count("*").alias("n"))


@query("src-20", with_derived("SELECT client, ok, count(*) AS n FROM usage WHERE NOT (client = 'ide' AND ok) GROUP BY ALL", "usage"))
def audit_sink(t: Tables) -> DataFrame:
    """Decisions are appended, but for those that were advice only."""
    store = GraphStore.temporary(t.spark)
    store.append("audit", t.usage.where("NOT (client = 'ide' AND ok)").select("event_id", "client", "ok"))
    return t.spark.read.schema("client string, ok boolean").json(f"{store.folder}/audit").groupBy("client", "ok").agg(F.count("*").alias("n"))


@query("src-22", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS version FROM embeddings")
def vector_sink(t: Tables) -> DataFrame:
    """The last entry of a vector's id stays, scope by scope."""
    store = GraphStore.temporary(t.spark)
    one = t.embeddings.select("vec_id", F.concat(F.lit("s"), F.col("label").cast("string")).alias("plugin"), F.lit(1).alias("version"), F.lit(0).alias("ord"))
    store.replace("vectors", one.union(one.where("vec_id % 5 = 0").withColumns({"version": F.lit(2), "ord": F.lit(1)})), ["vec_id"])
    return store.read("vectors").select("vec_id", "version")


@query("src-23", "SELECT vec_id, sha1(CAST(vec_id AS STRING)) AS h, len(embedding) AS width FROM embeddings WHERE vec_id % 3 > 0")
def checkpointed_sink(t: Tables) -> DataFrame:
    """What changed is embedded, checked for one width, and noted in a manifest that a second run goes by."""
    h = F.sha1(F.col("vec_id").cast("string"))
    changed = t.embeddings.where("vec_id % 3 > 0").select("vec_id", h.alias("h"), F.size("embedding").cast("long").alias("width"))
    first = written(changed.where("vec_id % 2 = 0"), "manifest")
    rest = changed.join(first.select("vec_id", "h"), ["vec_id", "h"], "left_anti")
    out = first.union(rest)
    one = F.count_distinct("width") == 1
    return out.join(F.broadcast(out.agg(F.when(one, True).otherwise(F.raise_error(F.lit("vectors of several widths")).cast("boolean")).alias("ok"))), F.col("ok")).drop("ok")


@query("src-25", with_derived("SELECT 'usage_calls_total{tool=\"' || tool || '\",client=\"' || client || '\"} ' || CAST(count(*) AS STRING) AS line FROM usage GROUP BY tool, client", "usage"))
def prometheus(t: Tables) -> DataFrame:
    """Metrics as text, a line each; labels are escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    counts = t.usage.groupBy("tool", "client").agg(F.count("*").alias("n"))
    line = F.format_string('usage_calls_total{tool="%s",client="%s"} %d', esc("tool"), esc("client"), F.col("n"))
    store = GraphStore.temporary(t.spark)
    counts.select(line.alias("value")).write.text(f"{store.folder}/metrics")
    return t.spark.read.text(f"{store.folder}/metrics").select(F.col("value").alias("line"))


def _versions(t: Tables) -> tuple[GraphStore, list[str]]:
    store = GraphStore.temporary(t.spark)
    return store, [store.build("nation", t.nation.withColumn("v", F.lit(i))) for i in range(4)]


@query("src-26", "SELECT v, count(*) AS n FROM nation, (SELECT unnest([0, 1, 2, 3]) AS v) GROUP BY v")
def build_begin(t: Tables) -> DataFrame:
    """Versions stand beside one another."""
    store, versions = _versions(t)
    out = None
    for v in versions:
        one = t.spark.read.parquet(f"{store.folder}/builds/{v}")
        out = one if out is None else out.union(one)
    return out.groupBy("v").agg(F.count("*").alias("n"))


@query("src-27", "SELECT n_nationkey, 2 AS v FROM nation")
def build_commit(t: Tables) -> DataFrame:
    """The version that was published last is read."""
    store, versions = _versions(t)
    for i in (0, 3, 2):
        store.publish("nation", versions[i])
    return store.published("nation").select("n_nationkey", "v")


@query("src-28", "SELECT 'before' AS at, CAST(NULL AS INT) AS v UNION ALL SELECT 'first', 1 UNION ALL SELECT 'second', 0")
def build_resolve(t: Tables) -> DataFrame:
    store, versions = _versions(t)
    rows = [("before", store.current("nation"))]
    for at, i in (("first", 1), ("second", 0)):
        store.publish("nation", versions[i])
        rows.append((at, store.current("nation")))
    return t.spark.createDataFrame([(at, versions.index(v) if v else None) for at, v in rows], "at string, v int")


@query("src-29", "SELECT unnest([0, 2, 3]) AS v")
def build_gc(t: Tables) -> DataFrame:
    """The two newest versions stay, and the current one."""
    store, versions = _versions(t)
    store.publish("nation", versions[0])
    gone = store.collect_garbage("nation", keep=2)
    return t.spark.createDataFrame([(i,) for i, v in enumerate(versions) if v not in gone], "v int")


def _builds(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The manifest, and builds that are to be published: each order is a build of a customer's project."""
    project, kind = F.concat(F.lit("p"), (F.col("o_custkey") % 300).cast("string")), F.element_at(F.array(*map(F.lit, ("codegraph", "ingest", "chroma"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = t.orders.select(project.alias("project_id"), kind.alias("kind"), F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("rows"))
    last = rows.groupBy("project_id", "kind").agg(F.max_by(F.struct("attempt", "status", "rows"), "attempt").alias("b")).select("project_id", "kind", "b.*")
    new = last.select("project_id", "kind", F.when(F.col("attempt") % 4 == 3, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), F.when(F.col("attempt") % 4 == 2, "X").otherwise(F.col("status")).alias("status"), "rows")
    return last.where("attempt % 4 > 0"), new.where("attempt % 7 > 0")


_LASTB = "lb AS (SELECT project_id, kind, max(attempt) AS attempt, arg_max(status, attempt) AS status, arg_max(rows, attempt) AS rows FROM (SELECT 'p' || CAST(o_custkey % 300 AS STRING) AS project_id, ['codegraph', 'ingest', 'chroma'][1 + o_orderkey % 3] AS kind, o_orderkey AS attempt, o_orderstatus AS status, o_totalprice AS rows FROM orders) GROUP BY ALL)"
_NEWB = "nb AS (SELECT * FROM (SELECT project_id, kind, CASE WHEN attempt % 4 = 3 THEN attempt + 1 ELSE attempt END AS attempt, CASE WHEN attempt % 4 = 2 THEN 'X' ELSE status END AS status, rows FROM lb) WHERE attempt % 7 > 0)"


@query("src-30", f"WITH {_LASTB} SELECT project_id, kind, attempt, status FROM lb")
def manifest_write(t: Tables) -> DataFrame:
    """One row a project and kind, the last that was recorded."""
    store = GraphStore.temporary(t.spark)
    project, kind = F.concat(F.lit("p"), (F.col("o_custkey") % 300).cast("string")), F.element_at(F.array(*map(F.lit, ("codegraph", "ingest", "chroma"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = t.orders.select(project.alias("project_id"), kind.alias("plugin"), F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("status"))
    store.replace("manifest", rows, ["project_id"], "attempt")
    return store.read("manifest").select("project_id", F.col("plugin").alias("kind"), "attempt", "status")


@query("src-30-log", f"WITH {_LASTB} SELECT project_id, kind, attempt, status FROM lb")
def logged_builds(t: Tables) -> DataFrame:
    """The last builds by a log: of three writers that began together, one has other values for rows that are published by now, and changes nothing."""
    store = GraphStore.temporary(t.spark)
    last = t.spark.sql("SELECT 'p' || CAST(o_custkey % 300 AS STRING) AS project_id, element_at(array('codegraph', 'ingest', 'chroma'), CAST(o_orderkey % 3 AS INT) + 1) AS kind, max(o_orderkey) AS attempt, max_by(o_orderstatus, o_orderkey) AS status FROM {orders} GROUP BY 1, 2", orders=t.orders)
    log = CommitLog(t.spark, f"{store.folder}/builds", "project_id string, kind string, attempt long, status string", ["project_id", "kind"])
    base, even = log.version(), last.where("attempt % 2 = 0")
    for rows in (even, even.withColumn("status", F.lit("X")), last.where("attempt % 2 = 1")):
        log.publish(rows, base)
    return log.read()


@query("src-31", f"WITH {_LASTB}, {_NEWB} SELECT nb.project_id, nb.kind, CASE WHEN lb.attempt % 4 > 0 AND lb.attempt = nb.attempt THEN CASE WHEN lb.status = nb.status THEN 'IDEMPOTENT' ELSE 'CONFLICT' END ELSE 'PUBLISHED' END AS outcome FROM nb JOIN lb USING (project_id, kind)")
def guarded_publish(t: Tables) -> DataFrame:
    return publish_builds(*_builds(t), ["status", "rows"])[1]


@query("src-32", f"WITH {_LASTB}, {_NEWB}, o AS (SELECT * FROM lb WHERE attempt % 4 > 0), m AS (SELECT project_id, kind, CASE WHEN nb.attempt IS NULL OR (o.attempt = nb.attempt AND o.status <> nb.status) THEN o.attempt ELSE nb.attempt END AS attempt, CASE WHEN nb.attempt IS NULL OR (o.attempt = nb.attempt AND o.status <> nb.status) THEN o.status ELSE nb.status END AS status FROM o FULL JOIN nb USING (project_id, kind)) SELECT project_id, kind, attempt, status FROM m WHERE project_id IN ('p1', 'p2', 'p3')")
def manifest_read(t: Tables) -> DataFrame:
    """The builds of some projects after the publication."""
    after = publish_builds(*_builds(t), ["status", "rows"])[0]
    return after.where("project_id IN ('p1', 'p2', 'p3')").select("project_id", "kind", "attempt", "status")


@query("src-33", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'feedback' ELSE 'reference' END AS kind, 'about ' || s_name AS description, 'Body of ' || CAST(s_suppkey AS STRING) || chr(10) || chr(10) || '---' || chr(10) || 'more' AS content FROM supplier WHERE s_suppkey % 3 < 2")
def memory_import(t: Tables) -> DataFrame:
    """Files with a head of names and values; others are passed over."""
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 3 == 2, "note").when(k % 2 == 0, "feedback").otherwise("reference"), F.lit("_"), k.cast("string"), F.lit(".md"))
    body = F.concat(F.lit("---\nname: x\ndescription: about "), F.col("s_name"), F.lit("\n---\nBody of "), k.cast("string"), F.lit("\n\n---\nmore\n"))
    files = t.supplier.select(k, name.alias("file"), body.alias("text"))
    head = r"(?s)^---\n(.*?)\n---\n(.*)$"
    held = files.where(F.col("file").rlike(r"^(feedback|reference)_.*\.md$")).withColumn("head", F.regexp_extract("text", head, 1))
    return held.select("s_suppkey", F.regexp_extract("file", "^([a-z]+)_", 1).alias("kind"), F.regexp_extract("head", r"(?m)^description:\s*(.*)$", 1).alias("description"), strip(F.regexp_extract("text", head, 2)).alias("content"))


@query("src-34", "SELECT 'p' || CAST(s_suppkey AS STRING) AS code, s_name AS name FROM supplier WHERE s_suppkey % 5 > 0")
def project_registry(t: Tables) -> DataFrame:
    """A file of JSON a project; those that cannot be read are passed over."""
    store = GraphStore.temporary(t.spark)
    text = F.when(F.col("s_suppkey") % 5 == 0, "{ broken").otherwise(F.to_json(F.struct(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_name").alias("name"))))
    t.supplier.select(text.alias("value")).write.text(f"{store.folder}/projects")
    return t.spark.read.schema("code string, name string").option("mode", "DROPMALFORMED").json(f"{store.folder}/projects").where("code IS NOT NULL")


@query("src-35", "SELECT o_orderkey, 'repo' || CAST(o_custkey % 50 AS STRING) AS repo, count(DISTINCT l_partkey) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY ALL UNION ALL SELECT o_orderkey, 'repo' || CAST(o_custkey % 50 AS STRING), 0 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def push_events(t: Tables) -> DataFrame:
    """Payloads of pushes, read as a stream in two runs from one checkpoint, in one neutral form with the files of all commits; other events are left out, and what cannot be read is kept apart."""
    commit = F.struct(*(F.collect_list(F.when(F.col("l_linenumber") % 3 == i, F.col("l_partkey").cast("string"))).alias(c) for i, c in enumerate(("added", "modified", "removed"))))
    commits = t.lineitem.groupBy("l_orderkey", F.floor(F.col("l_linenumber") / 2).alias("c")).agg(commit.alias("commit")).groupBy("l_orderkey").agg(F.collect_list("commit").alias("commits"))
    repo = F.concat(F.lit("repo"), (F.col("o_custkey") % 50).cast("string"))
    payload = F.to_json(F.struct(F.struct(repo.alias("name")).alias("repository"), F.coalesce("commits", F.array().cast(COMMITS)).alias("commits")))
    even = F.col("o_orderkey") % 2 == 0
    sent = t.orders.join(commits, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.struct(F.col("o_orderkey").cast("string").alias("id"), F.when(even, "push").otherwise("ping").alias("event"), payload.alias("body")).alias("p"))
    line = F.when(F.col("o_orderkey") % 30 == 1, F.substring(F.to_json("p"), 1, 40)).otherwise(F.to_json("p"))
    store = GraphStore.temporary(t.spark)
    for part in ("o_orderkey % 3 = 0", "o_orderkey % 3 > 0"):
        sent.where(part).select(line.alias("value")).write.mode("append").text(f"{store.folder}/arrived")
        stream = pushes(lines(t.spark, f"{store.folder}/arrived")).writeStream.option("checkpointLocation", f"{store.folder}/checkpoint").option("path", f"{store.folder}/pushes")
        stream.format("parquet").trigger(availableNow=True).start().awaitTermination()
    read = store.read("pushes").where("broken IS NULL")
    return read.select(F.col("id").cast("long").alias("o_orderkey"), "repo", F.size("files").cast("long").alias("files"))


@query("src-38", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey % 20 = 3")
def job_list(t: Tables) -> DataFrame:
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")).alias("project_id"), F.col("o_orderstatus").alias("status"))
    return jobs.where("project_id = 'p3'").select("id", "status")


@query("src-39", with_derived("SELECT id, id % 7 > 0 AS vector, status FROM memories WHERE id % 10 < 8", "memories"))
def dual_write(t: Tables) -> DataFrame:
    """Entries and their vectors from one stream. The first run cannot make vectors, which does not keep the entries from being written; the next one makes up for it. Some entries have no vector at all."""
    store = GraphStore.temporary(t.spark)
    m = t.memories.where("id % 10 < 8").select("id", "status")
    for part, works in (("id % 2 = 0", False), ("id % 2 = 1", True)):
        m.where(part).write.mode("append").parquet(f"{store.folder}/arrived")
        vectors = lambda rows, works=works: rows.where("id % 7 > 0").select("id", (F.col("id") if works else F.raise_error(F.lit("no model"))).cast("double").alias("v"))
        sinks = TwoSinks(t.spark, f"{store.folder}/sinks", vectors)
        sinks.drain(t.spark.readStream.schema(m.schema).parquet(f"{store.folder}/arrived"))
    return settled(sinks, "id long, status string", "id long, v double", "id").select("id", F.col("made").alias("vector"), "status")


# Memories by several scorers.

_SEEN = ", seen AS (SELECT * FROM memories WHERE status = 'active' AND org_id = 'o1' AND ((scope = 'org' AND scope_ref = 'org') OR (scope = 'project' AND scope_ref = 'p1') OR (scope = 'personal' AND scope_ref = 'u7')))"
_TOK = r"regexp_extract_all(lower({}), '[a-z_][a-z0-9_]*|[0-9]+(?:\.[0-9]+)*')"
_BM = f""", ml AS (SELECT id, {_TOK.format('content')} AS w FROM seen), mp AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM ml), mt AS (SELECT id, dl, term, count(*) AS tf FROM mp WHERE term IN ('purchase', 'user') GROUP BY ALL), md AS (SELECT term, count(*) AS df FROM mt GROUP BY term),
ms AS (SELECT id, sum(ln(1 + ((SELECT count(*) FROM ml) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(len(w)) FROM ml)))) AS s FROM mt JOIN md USING (term) GROUP BY id),
mr AS (SELECT seen.id, seen.is_redline, row_number() OVER (PARTITION BY org_id ORDER BY round(coalesce(s, 0), 6) DESC, created_at DESC, seen.id) - 1 AS rank FROM seen LEFT JOIN ms ON ms.id = seen.id)"""


def _bm25_ranks(t: Tables) -> DataFrame:
    """All entries of the pool by BM25, those without a word of the query last; of equal ones the newest first."""
    pool = cut(visible(t.memories, scopes(t)).select("id", "org_id", "content", "created_at", "is_redline", "task_id"))
    asked = t.spark.createDataFrame([(0, w) for w in TERMS], "q int, term string")
    scored = bm25(text_index(pool, "id", "content"), asked).select(F.col("doc").alias("id"), F.round("score", 6).alias("s"))
    return top(pool.join(scored, "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0))), ["org_id"], 1 << 30, F.desc("s"), F.desc("created_at"), "id")


@query("ret-19", with_derived(f"{_SEEN}{_BM} SELECT id, rank FROM mr", "memories"))
def bm25_scorer(t: Tables) -> DataFrame:
    return _bm25_ranks(t).select("id", "rank")


@query("ret-17", with_derived(f"""{_SEEN}{_BM}, kr AS (SELECT id, row_number() OVER (PARTITION BY org_id ORDER BY CASE WHEN is_redline THEN 0 ELSE 1 END, CASE WHEN task_id = 't3' THEN 0 ELSE 1 END, -(CAST(contains(lower(content), 'purchase') AS INT) + CAST(contains(lower(content), 'user') AS INT)), created_at DESC, id) - 1 AS rank FROM seen WHERE NOT is_redline),
l AS (SELECT id, 0 AS pos, rank FROM (SELECT id, rank FROM mr WHERE NOT is_redline AND rank < 30) UNION ALL SELECT id, 1, rank FROM kr WHERE rank < 30), fu AS (SELECT id, row_number() OVER (ORDER BY round(sum(1.0::DOUBLE / (61 + rank)), 9) DESC, min((pos, rank)), id) - 1 AS rank FROM l GROUP BY id)
SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY part, rank) - 1 AS place FROM (SELECT id, 0 AS part, rank FROM fu UNION ALL SELECT id, 1, rank FROM kr WHERE id NOT IN (SELECT id FROM fu))) WHERE place < 50""", "memories"))
def rank_rest(t: Tables) -> DataFrame:
    """Two scorers are fused; what neither brings follows in the order of keywords; the first 50."""
    by_text = _bm25_ranks(t).where("NOT is_redline AND rank < 30").select("org_id", "id", "rank")
    pool = visible(t.memories, scopes(t)).where("NOT is_redline")
    by_words = cut(top(pool, ["org_id"], 1 << 30, *keyword_order(TERMS, "t3")).select("org_id", "id", "rank"))
    lanes = by_text.select(F.col("org_id").alias("q"), F.lit("bm25").alias("lane"), F.lit(0).alias("at"), F.col("id").alias("ref"), "rank").union(by_words.where("rank < 30").select("org_id", F.lit("words"), F.lit(1), "id", "rank"))
    fused = rrf(lanes, limit=1 << 30).select(F.col("q").alias("org_id"), F.col("ref").alias("id"), F.lit(0).alias("part"), "rank")
    rest = by_words.join(fused.select("id"), "id", "left_anti").select("org_id", "id", F.lit(1), "rank")
    return top(fused.union(rest).withColumnRenamed("rank", "r"), ["org_id"], 50, "part", "r").select("id", F.col("rank").alias("place"))


@query("ret-20", with_derived("""SELECT q, id, rank FROM (SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) - 1 AS rank FROM embeddings a, embeddings b JOIN (SELECT id FROM memories WHERE status = 'active' AND org_id = 'o1' AND ((scope = 'org' AND scope_ref = 'org') OR (scope = 'project' AND scope_ref = 'p1') OR (scope = 'personal' AND scope_ref = 'u7'))) m ON m.id = b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank < 10""", "memories"))
def memory_vectors(t: Tables) -> DataFrame:
    """The nearest entries that a caller sees; without scopes, none."""
    pool = t.embeddings.join(visible(t.memories, scopes(t)).select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    asks = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return cosine(pool, asks, 10).select("q", F.col("doc").alias("id"), "rank")


# Indexes that are kept up to date.


def _changed(text: Column) -> Column:
    return F.when(F.col("s_suppkey") % 4 == 1, F.concat(text, F.lit("\nnew"))).otherwise(text)


def update_index(store: GraphStore, table: str, old: DataFrame | None, files: DataFrame, made: DataFrame, key: str, force: bool = False) -> tuple[str, DataFrame]:
    """files: key, h; made: key, chunk_id, chunk. What is new or has another digest is indexed anew, what is gone is left out, the rest is kept; the result is published if its ids are those that are expected.
    Without an index, or by force, all is made anew. Returns how it was done, and the index."""
    full = old is None or force
    if full:
        rows = made.join(files, key)
    else:
        same = cut(files.join(old.select(key, "h").distinct(), [key, "h"], "left_semi"))
        rows = old.join(same.select(key), key, "left_semi").select(key, "chunk_id", "chunk", "h").unionByName(made.join(files.join(same.select(key), key, "left_anti"), key).select(key, "chunk_id", "chunk", "h"))
    version = store.build(table, rows.select(key, "chunk_id", "chunk", "h"))
    built = store.spark.read.parquet(f"{store.folder}/builds/{version}")
    proof = built.groupBy("chunk_id").agg(F.count("*").alias("n")).join(made.join(files.select(key), key, "left_semi").select("chunk_id", F.lit(1).alias("m")), "chunk_id", "full")
    if proof.where("n IS NULL OR m IS NULL OR n > 1").limit(1).count():
        raise ValueError("the ids of the index are not those of the files")
    store.publish(table, version)
    return "full" if full else "incremental", store.published(table)


def _indexed(t: Tables, change: bool) -> DataFrame:
    store = GraphStore.temporary(t.spark)
    first = notes(t).where("s_suppkey % 9 > 0")
    second = notes(t).where("s_suppkey % 7 > 0").withColumn("text", _changed(F.col("text")))
    digest = lambda df: df.select("s_suppkey", F.sha2("text", 256).alias("h"))
    parts = lambda df: chunks(df, "s_suppkey", "text").where("chunk IS NOT NULL").select("s_suppkey", "chunk_id", "chunk")
    how, index = update_index(store, "chunks", None, digest(first), parts(first), "s_suppkey")
    if change:
        how, index = update_index(store, "chunks", index, digest(second), parts(second), "s_suppkey")
    return index.withColumn("how", F.lit(how))


@query("ret-25", f"{_NOTES} SELECT s_suppkey, 'incremental' AS how, sha256(CASE WHEN s_suppkey % 4 = 1 THEN text || chr(10) || 'new' ELSE text END) AS h FROM d WHERE s_suppkey % 7 > 0")
def incremental_index(t: Tables) -> DataFrame:
    """An index, and then some files changed, some gone and some new."""
    return _indexed(t, True).select("s_suppkey", "how", "h").distinct()


@query("ret-26", f"{_NOTES} SELECT s_suppkey, 'full' AS how, sha256(text) AS h FROM d WHERE s_suppkey % 9 > 0")
def index_build(t: Tables) -> DataFrame:
    return _indexed(t, False).select("s_suppkey", "how", "h").distinct()
