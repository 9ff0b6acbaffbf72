"""Analyses of a graph: soft labels and their quality, clusters of endpoints, facts of files, reports over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.kinds import LAYERS, ROLE_RANKS, is_soft_edge, is_soft_node, lookup
from graphloom.operators.reach import Reached, shared_links, table_counts, without
from graphloom.operators.shared import cut

# What makes a label giant, a coverage low, and a table a hub; caps of requests.
GIANT, LOW, COMMUNITY_GIANT = 0.5, 0.3, 0.7
HUB_LEAST, HUB_AT = 3, 0.95
MEMBERS, SOFT_CONFIDENCE = 40, 0.7


def usage_edges(files: DataFrame, sources: DataFrame, constants: DataFrame) -> DataFrame:
    """files: file, text; sources: file, id, kind, ord; constants: name, api, file. Edges from the node of a file (a component before a module) to the constants that its text names, but for the file that
    declares them; only names in capitals of four letters or more count, and of several constants of one name the first."""
    node = sources.groupBy("file").agg(F.min_by("id", F.struct((F.col("kind") != "frontend_component").cast("int"), "ord")).alias("source"))
    real = constants.where(F.col("name").rlike("^[A-Z][A-Z0-9_]{3,}$")).groupBy("name").agg(F.min_by(F.struct("api", "file"), "ord").alias("c"))
    tokens = files.select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), 0))).alias("name"))
    met = tokens.join(real, "name").where(~F.col("file").eqNullSafe(F.col("c.file"))).join(node, "file")
    return met.select("source", F.col("c.api").alias("target"), F.lit("uses_api").alias("kind"), F.lit(1.0).alias("confidence")).distinct()


def arch_violations(nodes: DataFrame, edges: DataFrame, roles: DataFrame) -> DataFrame:
    """roles: id, role. calls and imports from a lower role to a higher one: from, from_role, to, to_role, via. Roles without a rank may be used by all."""
    rank = lambda c: lookup(F.col(c), ROLE_RANKS, -1)
    ranked = roles.where(F.col("role").isin(*ROLE_RANKS))
    deps = edges.where(F.col("kind").isin("calls", "imports")).select("source", "target", F.col("kind").alias("via"))
    met = deps.join(ranked.select(F.col("id").alias("source"), F.col("role").alias("from_role")), "source").join(ranked.select(F.col("id").alias("target"), F.col("role").alias("to_role")), "target")
    return met.where(rank("from_role") > rank("to_role")).join(nodes.select(F.col("id").alias("source"), F.col("name").alias("from")), "source")


def contract_drift(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """Frontend calls without an edge to the backend (dangling), or with none that is certain (uncertain): the first of each bucket by file and line."""
    best = edges.where("kind = 'calls_api'").groupBy(F.col("source").alias("id")).agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("best"))
    calls = nodes.where("kind = 'frontend_api_call'").select("id", "file", "line").join(best, "id", "left").where("best IS NULL OR best < 0.7D")
    rows = calls.select("id", "file", "line", F.when(F.col("best").isNull(), "dangling").otherwise("uncertain").alias("bucket"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("file", "line", "id"))).where(F.col("place") <= limit)


def soft_axis(nodes: DataFrame, edges: DataFrame, soft_kind: str, soft_edge: str, eligible: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Labels (name, members, files, share) and one row of the axis (soft_nodes, labelled, eligible, coverage).

    Members are nodes; files are the files they are in (a node without one is a unit of its own), so that a file of many nodes does not make a label large."""
    soft = nodes.where(F.col("kind") == soft_kind).select(F.col("id").alias("target"), F.col("name").alias("label")).dropDuplicates(["target"])
    units = nodes.groupBy(F.col("id").alias("source")).agg(F.min("file").alias("file"))
    member = edges.where(F.col("kind") == soft_edge).join(soft, "target").join(units, "source", "left").select("target", "label", "source", F.coalesce("file", "source").alias("unit"))
    labels = member.groupBy("target", "label").agg(F.countDistinct("source").alias("members"), F.countDistinct("unit").alias("files"))
    total = labels.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total"))
    labels = labels.crossJoin(F.broadcast(total)).select(F.col("label").alias("name"), "members", "files", (F.col("files") / F.col("total")).alias("share"))
    able = nodes.where(F.col("kind").isin(*eligible)).select("id").distinct()
    counts = able.join(member.select(F.col("source").alias("id")).distinct().withColumn("has", F.lit(1)), "id", "left").agg(F.count("*").alias("eligible"), F.coalesce(F.sum("has"), F.lit(0)).alias("labelled"))
    axis = counts.crossJoin(F.broadcast(soft.agg(F.count("*").alias("soft_nodes")))).select("soft_nodes", "labelled", "eligible", F.when(F.col("eligible") > 0, F.col("labelled") / F.col("eligible")).alias("coverage"))
    return labels, axis


def axis_flags(labels: DataFrame, axis: DataFrame, giant: float = GIANT, low: float = LOW) -> DataFrame:
    """flag, detail: giant labels (over more than one file, if there are two labels), low coverage, and mostly labels of one node."""
    several = labels.agg(F.count("*").alias("n"), F.count_if(F.col("members") <= 1).alias("single"))
    big = labels.crossJoin(F.broadcast(several)).where((F.col("n") >= 2) & (F.col("files") > 1) & (F.col("share") > giant)).select(F.lit("giant").alias("flag"), F.col("name").alias("detail"))
    weak = axis.where((F.col("soft_nodes") > 0) & (F.col("coverage") < low)).select(F.lit("low_coverage"), F.lit(None).cast("string"))
    lone = several.crossJoin(F.broadcast(axis)).where((F.col("soft_nodes") >= 4) & (2 * F.col("single") >= F.col("soft_nodes"))).select(F.lit("singletons"), F.lit(None).cast("string"))
    return big.union(weak).union(lone)


def hub_tables(fan: DataFrame) -> DataFrame:
    """fan: table, n (how many endpoints reach it). Those of tables that as many endpoints reach as at the 95th place of a hundred tables, and three at least."""
    fan = cut(fan)
    counts = fan.groupBy("n").agg(F.count("*").alias("c"))
    # One row for each different count.
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("n"))).crossJoin(F.broadcast(fan.agg(F.count("*").alias("all"))))
    place = F.least(F.col("all") - 1, F.floor(F.col("all") * HUB_AT)) + 1
    threshold = run.where(F.col("upto") >= place).agg(F.greatest(F.lit(HUB_LEAST), F.min("n")).alias("least"))
    return fan.crossJoin(F.broadcast(threshold)).where("n >= least").select("table", "n")


def reach_pairs(walk: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """walk: here, there; starts: id. start, id, depth: what each start reaches, itself included."""
    frontier = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
    seen = frontier
    for depth in range(1, max_depth + 1):
        found = frontier.select("start", F.col("id").alias("here")).join(walk, "here").select("start", F.col("there").alias("id")).distinct()
        frontier = cut(found.join(seen, ["start", "id"], "left_anti").select("start", "id", F.lit(depth).alias("depth")))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    return seen


def endpoint_clusters(endpoints: DataFrame, reached: Reached, hubs: DataFrame) -> DataFrame:
    """endpoints: id, file; reached: their tables; hubs: table. id, root: endpoints of one file belong together; those without one, if they share a table that is no hub. The root is the smallest id."""
    from graphloom.operators.community import components

    filed, mark = F.coalesce("file", F.lit("")) != "", lambda c: F.concat(F.lit("￿￿"), F.col(c).cast("string"))
    loose = without(reached, hubs).join(endpoints.where(~filed).select("id").distinct(), "id", "left_semi")
    shared = cut(shared_links(loose, reached.width))
    # What links stands behind all ids in the order, so it is never a root.
    links = endpoints.where(filed).select(F.col("id").alias("u"), F.concat(F.lit("￿"), "file").alias("v")).union(shared.select(F.coalesce("id", mark("v")), mark("u")))
    met = components(links)
    return endpoints.select("id").distinct().join(met.where(~F.startswith("id", F.lit("￿"))), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def cluster_requests(clusters: DataFrame, reached: Reached, hubs: DataFrame, most: int = MEMBERS) -> DataFrame:
    """root, ref, kind, id: the members of each cluster's request: endpoints first (e1, e2, ...), then tables by how many of its endpoints reach them (t1, ...), at most so many."""
    ends = clusters.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("id"))).where(F.col("n") <= most)
    tables = table_counts(reached, without(reached, hubs).join(clusters, "id"), "root").withColumnRenamed("n", "d")
    room = ends.groupBy("root").agg((F.lit(most) - F.count("*")).alias("room"))
    few = tables.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("d"), "table"))).join(room, "root").where("n <= room")
    ref = lambda letter: F.concat(F.lit(letter), F.col("n").cast("string")).alias("ref")
    return ends.select("root", ref("e"), F.lit("endpoint").alias("kind"), "id").union(few.select("root", ref("t"), F.lit("table"), "table"))


def file_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file, endpoint, functions, tables, imports_out, imports_in, frontend (all its nodes are), page."""
    held = nodes.where("file IS NOT NULL")
    facts = held.groupBy("file").agg(F.bool_or(F.col("kind") == "backend_endpoint").alias("endpoint"), F.count_if(F.col("kind") == "backend_function").alias("functions"), F.bool_and(F.col("kind").isin(*LAYERS["frontend"])).alias("frontend"), F.bool_or(F.coalesce("is_page", F.lit(False))).alias("page"))
    at = held.groupBy("id").agg(F.max_by("file", "ord").alias("file"))
    near = lambda side: edges.join(at.withColumnRenamed("id", side), side)
    out = near("source").groupBy("file").agg(F.count_if(F.col("kind") == "imports").alias("imports_out"), F.countDistinct(F.when(F.col("kind").isin("reads_table", "writes_table"), F.col("target"))).alias("tables"))
    into = near("target").where("kind = 'imports'").groupBy("file").agg(F.count("*").alias("imports_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return facts.join(out, "file", "left").join(into, "file", "left").select("file", "endpoint", "functions", zero("tables"), zero("imports_out"), zero("imports_in"), "frontend", "page")


def blind_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files of frontend nodes of which none has an edge to the backend, sure or inferred."""
    linked = edges.where(F.col("kind").isin("calls_api", "calls_api_inferred")).select(F.col("source").alias("id")).distinct()
    files = nodes.where("file IS NOT NULL").select("id", "file")
    return nodes.where(F.col("kind").isin(*LAYERS["frontend"]) & F.col("file").isNotNull()).select("file").distinct().join(files.join(linked, "id", "left_semi").select("file").distinct(), "file", "left_anti")


def validated(soft_nodes: DataFrame, soft_edges: DataFrame, hard: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Soft edges between what there is (hard nodes and the soft ones given), and confidences below 1: those that are not become the default."""
    ids = hard.select("id").union(soft_nodes.select("id")).distinct()
    kept = soft_edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    sure = lambda: F.when(F.col("confidence") < 1, F.col("confidence")).otherwise(SOFT_CONFIDENCE)
    return soft_nodes.withColumn("confidence", sure()), kept.withColumn("confidence", sure())


def hard_part(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.where(~is_soft_node(F.col("kind"))), edges.where(~is_soft_edge(F.col("kind")))


# Chunks of code.


def windows_of(lines: list[str], budget: int, overlap: int) -> Iterator[str]:
    """Windows of whole lines within a number of characters, each beginning some lines before the end of the last, but always later than it; a line that is too long is cut and stands alone."""
    at = 0
    while at < len(lines):
        if len(lines[at]) + 1 > budget:
            end, text = at + 1, lines[at][:budget]
        else:
            end, size = at, 0
            while end < len(lines) and (end == at or size + len(lines[end]) + 1 <= budget):
                size += len(lines[end]) + 1
                end += 1
            text = "\n".join(lines[at:end])
        yield text
        if end >= len(lines):
            return
        at = max(end - overlap, at + 1)


def line_windows(files: DataFrame, budget: int = 3500, overlap: int = 8) -> DataFrame:
    """files: path, text. path, at, window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(p, i, w) for p, t in zip(pdf["path"], pdf["text"], strict=True) if t is not None for i, w in enumerate(windows_of(t.split("\n"), budget, overlap))], columns=["path", "at", "window"])

    return files.select("path", "text").mapInPandas(run, "path string, at int, window string")


def source_slice(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols: id, path, start_line, end_line; files: path, text. id, lines: the source of each; a path that leads out of the repository, or a symbol without a start, gives none."""
    safe = symbols.where(~F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))") & (F.col("start_line") > 0))
    met = safe.join(files, "path")
    return met.select("id", F.slice(F.split("text", "\n"), F.col("start_line"), F.greatest(F.coalesce("end_line", "start_line") - F.col("start_line") + 1, F.lit(0))).alias("lines"))


def head_at_line(lines: Column, budget: int) -> Column:
    """Whole lines from the first on, as many as fit, one at least."""
    add = lambda s, x: F.when(s["full"], s).when((s["n"] == 0) | (s["size"] + F.length(x) + 1 <= budget), F.struct((s["n"] + 1).alias("n"), (s["size"] + F.length(x) + 1).alias("size"), F.lit(False).alias("full"))).otherwise(F.struct(s["n"].alias("n"), s["size"].alias("size"), F.lit(True).alias("full")))
    taken = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("full")), add)
    return F.array_join(F.slice(lines, F.lit(1), taken["n"]), "\n")


def code_chunks(symbols: DataFrame, files: DataFrame, base: Column, container: tuple[str, ...] = ("class", "interface", "enum", "struct", "trait", "module", "namespace"), body: tuple[str, ...] = ("method", "function", "constructor", "component"), head: int = 1800, budget: int = 3500, overlap: int = 8, most: int = 12) -> DataFrame:
    """id, chunk_id, text: a container's description and the head of its source; a long body in windows, each with the description; else one chunk."""
    told = symbols.withColumn("base", base)
    lines = source_slice(told.select("id", "path", "start_line", "end_line"), files)
    met = told.select("id", "kind", "base").join(lines, "id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>"))).withColumn("source", F.array_join("lines", "\n"))
    long = F.col("kind").isin(*body) & (F.length("source") > budget)
    text = F.when(F.col("kind").isin(*container), head_at_line(F.col("lines"), head)).otherwise(head_at_line(F.col("lines"), budget))
    one = met.where(~long).select("id", F.col("id").alias("chunk_id"), F.concat_ws("\n", F.nullif("base", F.lit("")), F.nullif(text, F.lit(""))).alias("text")).where(F.trim("text") != "")
    cut_ = line_windows(met.where(long).select(F.col("id").alias("path"), F.col("source").alias("text")), budget, overlap).where(F.col("at") < most)
    many = cut_.join(met.select(F.col("id").alias("path"), "base"), "path").select(F.col("path").alias("id"), F.concat_ws("#", "path", F.col("at").cast("string")).alias("chunk_id"), F.concat_ws("\n", "base", "window").alias("text"))
    return one.union(many)
