"""Files to nodes and edges. files: path, text. Most scanners are patterns over whole texts in expressions; what needs a syntax tree is a small function a file."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import sqltext
from graphloom.functions.rules import is_test_path



def scan(files: DataFrame, scanner: Callable[[str], Iterable[tuple]], columns: str) -> DataFrame:
    """One row for each find of a scanner in a file, and path; a file it cannot read gives none."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p, *found) for p, text in zip(pdf["path"], pdf["text"], strict=True) if text for found in scanner(text)]
            yield pd.DataFrame(rows, columns=["path", *names])

    return files.select("path", "text").mapInPandas(run, f"path string, {columns}")


def of_kind(files: DataFrame, *suffixes: str) -> DataFrame:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | F.endswith("path", F.lit(s))
    return files.where(hit)


def each(files: DataFrame, pattern: str, *names: str) -> DataFrame:
    """path, at, and the groups of each match of a pattern, in order."""
    return files.select("path", F.posexplode(sqltext.groups(F.col("text"), pattern, *names)).alias("at", "m")).select("path", "at", "m.*")


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


# Tables and what reads and writes them.


def ddl(files: DataFrame) -> DataFrame:
    return scan(files.where(F.lower("text").contains("create")), sqltext.created_tables, "table string, column string, type string")


def table_nodes(columns: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """columns: path, table, column. Nodes (id, kind, name, file) of tables and columns, each id once, and defines_column edges."""
    table = F.concat_ws(":", F.lit(project), F.lit("db_table"), F.lower("table"))
    column = F.concat(F.lit(f"{project}:db_column:"), F.lower("table"), F.lit("."), F.lower("column"))
    rows = columns.select(table.alias("t"), column.alias("c"), "table", "column", "path")
    nodes = rows.select(F.col("t").alias("id"), F.lit("db_table").alias("kind"), F.col("table").alias("name"), F.col("path").alias("file")).union(rows.where(F.col("column").isNotNull()).select("c", F.lit("db_column"), "column", "path"))
    return first_of(nodes, ["id"], "file", "name"), rows.where(F.col("column").isNotNull()).select(F.col("t").alias("source"), F.col("c").alias("target"), F.lit("defines_column").alias("kind")).distinct()


def accesses(statements: DataFrame, *keys: str) -> DataFrame:
    """statements: keys, sql. keys, table, access: what a statement writes is no read of it."""
    writes, reads = sqltext.table_access(F.col("sql"))
    both = statements.select(*keys, writes.alias("w"), reads.alias("r"))
    return both.select(*keys, F.explode("w").alias("table"), F.lit("writes_table").alias("access")).union(both.select(*keys, F.explode("r"), F.lit("reads_table"))).distinct()


def access_edges(found: DataFrame, known: DataFrame, project: str, confidence: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """found: path, function, table, access; known: table. Edges to tables, and nodes of those that nothing defines."""
    table = F.concat_ws(":", F.lit(project), F.lit("db_table"), F.col("table"))
    edges = found.select(F.concat_ws(":", F.lit(project), F.lit("backend_function"), "path", "function").alias("source"), table.alias("target"), F.col("access").alias("kind"), F.lit(confidence).alias("confidence")).distinct()
    stubs = found.select("table").distinct().join(known.select("table").distinct(), "table", "left_anti")
    return edges, stubs.select(table.alias("id"), F.lit("db_table").alias("kind"), F.col("table").alias("name"), F.lit(True).alias("inferred"))


def python_sql(files: DataFrame) -> DataFrame:
    """path, function, table, access: from the SQL in the string constants of functions; outside of functions the file's name stands for one."""
    found = scan(of_kind(files, ".py"), sqltext.python_statements, "function string, sql string")
    owner = F.coalesce("function", F.concat(F.lit("<"), F.element_at(F.split("path", "/"), -1), F.lit(">")))
    return accesses(found.withColumn("function", owner), "path", "function")


def models(files: DataFrame) -> DataFrame:
    return scan(of_kind(files, ".py"), sqltext.python_models, "class string, table string, column string")


def core_tables(files: DataFrame) -> DataFrame:
    return scan(of_kind(files, ".py"), sqltext.core_tables, "variable string, table string, column string, type string")


def core_accesses(files: DataFrame, tables: DataFrame) -> DataFrame:
    """tables: variable, table. path, function, table, access of statement builders on known variables; a table that a function writes is no read of it."""
    found = scan(of_kind(files, ".py"), sqltext.core_statements, "function string, variable string, access string")
    met = found.join(tables.select("variable", "table").distinct(), "variable").select("path", "function", "table", "access").distinct()
    written = met.where("access = 'writes_table'").select("path", "function", "table")
    return met.where("access = 'writes_table'").union(met.where("access = 'reads_table'").join(written, ["path", "function", "table"], "left_anti"))


_STRINGS = r'"([^"]*)"'
_ANNOTATED = r'@(?:Select|Insert|Update|Delete)\s*\(((?:[^"()]|"[^"]*")*)\)\s*(?:@\w+(?:\([^)]*\))?\s*)*[\w<>\[\],.?\s]*?(\w+)\s*\('


def java_sql(files: DataFrame) -> DataFrame:
    """path, function, table, access: the strings of an annotation are one statement of the method after it."""
    found = each(of_kind(files, ".java"), _ANNOTATED, "args", "function")
    return accesses(found.select("path", "function", F.array_join(F.regexp_extract_all("args", F.lit(_STRINGS), 1), " ").alias("sql")), "path", "function")


def hql(files: DataFrame, entities: DataFrame) -> DataFrame:
    """entities: entity, table. path, function, table, access: strings that begin as queries, of the nearest class before them; only known entities count."""
    parts = each(of_kind(files, ".java"), r'\bclass\s+(\w+)|"([^"]*)"', "class", "literal")
    owner = F.last(F.nullif("class", F.lit("")), ignorenulls=True).over(Window.partitionBy("path").orderBy("at"))
    said = parts.withColumn("function", F.coalesce(owner, F.concat(F.lit("<"), F.element_at(F.split("path", "/"), -1), F.lit(">")))).where(F.col("literal").rlike(r"(?i)^\s*(from|select|update|delete)\b"))
    names = lambda pattern, access: F.transform(F.regexp_extract_all("literal", F.lit(pattern), 1), lambda x: F.struct(F.lower(x).alias("entity"), F.lit(access).alias("access")))
    every = F.concat(names(r"(?i:\b(?:from|join))\s+([A-Z]\w+)", "reads_table"), names(r"(?i:\bupdate|\bdelete\s+from)\s+([A-Z]\w+)", "writes_table"))
    met = said.select("path", "function", "at", F.explode(every).alias("e")).select("path", "function", "at", "e.*").join(entities.select(F.lower("entity").alias("entity"), F.lower("table").alias("table")).distinct(), "entity")
    wrote = met.where("access = 'writes_table'").select("path", "at", "table").distinct()
    reads = met.where("access = 'reads_table'").join(wrote, ["path", "at", "table"], "left_anti")
    return met.where("access = 'writes_table'").unionByName(reads).select("path", "function", "table", "access").distinct()


def mappers(files: DataFrame) -> DataFrame:
    """path, function (the last part of the namespace and the statement's id), table, access of mapper files; dynamic tags, comments and places of values go."""
    held = of_kind(files, ".xml").where(F.col("text").rlike("(?i)<mapper\\b"))
    space = F.coalesce(F.nullif(F.regexp_extract("text", r'(?i)<mapper\b[^>]*\bnamespace\s*=\s*"([^"]+)"', 1), F.lit("")), F.col("path"))
    found = held.select("path", space.alias("space"), F.explode(sqltext.groups(F.col("text"), r'(?is)<(select|insert|update|delete)\b[^>]*\bid\s*=\s*"([^"]+)"[^>]*>(.*?)</\1>', "verb", "id", "body")).alias("m"))
    sql = F.col("m.body")
    for pattern, put in ((r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), (r"(?s)<!--.*?-->", " "), (r"<[^>]+>", " "), (r"[#$]\{[^}]*\}", "?")):
        sql = F.regexp_replace(sql, pattern, put)
    return accesses(found.select("path", F.concat_ws(".", F.element_at(F.split("space", r"\."), -1), "m.id").alias("function"), sql.alias("sql")), "path", "function")


_MAPPED, _HELD = ("class", "joined-subclass", "subclass", "union-subclass"), ("property", "id", "key", "version", "timestamp", "many-to-one", "key-many-to-one", "key-property", "discriminator")


def mapped_classes(source: str) -> Iterator[tuple[str, str, str | None]]:
    """entity, table, column of a mapping file: the columns of a nested class with a table are its own."""
    if "<hibernate-mapping" not in source:
        return
    try:
        root = ElementTree.fromstring(re.sub(r"(?is)<!DOCTYPE.*?>", "", source))
    except ElementTree.ParseError:
        return
    for el in root.iter():
        table = re.sub(r'[`"\[\]]', "", el.get("table") or "").split(".")[-1].lower()
        if el.tag in _MAPPED and len(table) >= 2 and table not in sqltext.KEYWORDS and not table.isdigit():
            inside = [c for c in el if c.tag in _HELD]
            columns = [n for c in inside for n in ([c.get("column")] if c.get("column") else [x.get("name") for x in c.findall("column")]) if n]
            yield from ((el.get("name", "").split(".")[-1], table, c.strip("`\"[]").lower()) for c in dict.fromkeys(columns) or [""])


def mapping_files(files: DataFrame) -> DataFrame:
    return scan(of_kind(files, ".xml"), mapped_classes, "entity string, table string, column string")


def plus_mappers(files: DataFrame) -> DataFrame:
    """path, function, table, access: a mapper of an entity with a named table may read and write it, which is less than sure."""
    java = of_kind(files, ".java")
    named = each(java, r'(?s)@TableName\(\s*(?:value\s*=\s*)?"([^"]+)".*?\bclass\s+(\w+)', "table", "entity").select("entity", sqltext.bare_name(F.col("table")).alias("table")).distinct()
    made = each(java, r"\binterface\s+(\w+)\s+extends\s+BaseMapper\s*<\s*(\w+)\s*>", "function", "entity")
    met = made.join(named.where(sqltext.plausible_table(F.col("table"))), "entity").select("path", "function", "table")
    return met.select("*", F.explode(F.array(F.lit("reads_table"), F.lit("writes_table"))).alias("access")).distinct()


def entities(files: DataFrame) -> DataFrame:
    """path, entity, table, column of classes with an entity's annotation and a named table; a column without a name has its field's."""
    held = each(of_kind(files, ".java"), r"(?s)@Entity\b(.*?)\bclass\s+(\w+)[^{]*\{(.*?)(?:\n\}|\z)", "head", "entity", "body").withColumn("table", F.lower(F.regexp_extract("head", r'@Table\s*\([^)]*?\bname\s*=\s*"([^"]+)"', 1))).where("table <> ''")
    column = sqltext.groups(F.col("body"), r"@Column\b(?:\(([^)]*)\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:private|protected|public|static|final|transient|volatile)\s+)+([\w<>.?]+)\s+(\w+)\s*[=;]", "args", "type", "field")
    named = F.coalesce(F.nullif(F.regexp_extract("c.args", r'\bname\s*=\s*"([^"]+)"', 1), F.lit("")), F.col("c.field"))
    return held.select("path", "entity", "table", F.explode_outer(column).alias("c")).select("path", "entity", "table", F.lower(named).alias("column"))


def model_queries(files: DataFrame, known: DataFrame) -> DataFrame:
    """known: entity, table. path, function, table: methods that select by the root of a query model of a known entity."""
    java = of_kind(files, ".java")
    models_ = each(java, r"\bclass\s+(Q\w+)\s+extends\s+BaseModelExpression\s*<\s*(\w+)", "model", "entity").select("model", F.lower("entity").alias("entity")).distinct()
    roots = each(java, r"BaseModelExpression\s*<[^;=]+>\s+(\w+)\s*=\s*new\s+(Q\w+)\s*\(", "root", "model").select("root", "model").distinct()
    parts = each(java, r"(?m)^[ \t]*(?:public|private|protected)\s+(?:static\s+|final\s+|synchronized\s+)*[\w<>\[\],.?]+\s+(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[^{]+)?\{|\b(Q\w+)\s*\.\s*(\w+)\s*\.\s*(?:select|selectCount)\s*\(", "method", "model", "root")
    owner = F.last(F.nullif("method", F.lit("")), ignorenulls=True).over(Window.partitionBy("path").orderBy("at"))
    used = parts.withColumn("function", owner).where("model <> '' AND function IS NOT NULL").select("path", "function", "model", "root")
    return used.join(roots, ["model", "root"]).join(models_, "model").join(known.select(F.lower("entity").alias("entity"), F.lower("table").alias("table")).distinct(), "entity").select("path", "function", "table").distinct()


def sql_plugin(files: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all SQL sources: first what defines tables, then what uses them; files of tests are left out. Of nodes with one id and of edges with one key, the first pass's stay."""
    kept = files.where(~is_test_path(F.col("path")))
    core = core_tables(kept)
    mapped = mapping_files(kept).select("path", "entity", "table", F.nullif("column", F.lit("")).alias("column")).union(entities(kept))
    defined = [ddl(kept), models(kept), core, mapped]
    columns = None
    for at, d in enumerate(defined):
        one = d.select(F.lit(at).alias("pass"), "path", "table", "column")
        columns = one if columns is None else columns.union(one)
    nodes, edges = table_nodes(columns, project)
    known = columns.select(F.lower("table").alias("table")).distinct()
    used = [(python_sql(kept), 1.0), (core_accesses(kept, core), 0.9), (java_sql(kept), 1.0), (hql(kept, mapped), 0.8), (mappers(kept), 1.0), (plus_mappers(kept), 0.6), (model_queries(kept, mapped).withColumn("access", F.lit("reads_table")), 0.9)]
    all_edges = edges.select(F.lit(0).alias("pass"), "source", "target", "kind", F.lit(1.0).alias("confidence"))
    all_nodes = nodes.select(F.lit(0).alias("pass"), "id", "kind")
    for at, (found, confidence) in enumerate(used, 1):
        more, stubs = access_edges(found, known, project, confidence)
        all_edges = all_edges.union(more.select(F.lit(at), "source", "target", "kind", "confidence"))
        all_nodes = all_nodes.union(stubs.select(F.lit(at), "id", "kind")).union(more.select(F.lit(at), "source", F.lit("backend_function")).distinct())
    return first_of(all_nodes, ["id"], "pass").drop("pass"), first_of(all_edges, ["source", "target", "kind"], "pass").drop("pass")


# Endpoints.


def fastapi(files: DataFrame) -> DataFrame:
    return scan(of_kind(files, ".py"), sqltext.python_routes, "method string, url string, handler string, line int")


def joined_url(*parts: Column) -> Column:
    """Parts of an address with one slash between them and none at the end."""
    url = F.concat(F.lit("/"), F.array_join(F.filter(F.transform(F.array(*parts), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", "")), lambda p: p != ""), "/"))
    return F.regexp_replace(url, "(?<=.)/+$", "")


def spring(files: DataFrame) -> DataFrame:
    """path, method, url, handler, controller_file: mappings of methods below their class's; those of an interface are served by the class that implements it."""
    java = of_kind(files, ".java")
    head = r'(?s)(?:@RequestMapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]*)"[^)]*\)[^{;]*?)?\b(class|interface)\s+(\w+)([^{]*)\{'
    kinds = each(java, head, "base", "kind", "name", "rest").where("at = 0")
    route = r'@(?:(Get|Post|Put|Delete|Patch)Mapping|RequestMapping)\s*\(((?:[^"()]|"[^"]*")*)\)\s*(?:@\w+(?:\([^)]*\))?\s*)*[\w<>\[\],.?\s]*?(\w+)\s*\('
    found = each(java, route, "verb", "args", "handler")
    verb = F.upper(F.coalesce(F.nullif("verb", F.lit("")), F.nullif(F.regexp_extract("args", r"RequestMethod\.(\w+)", 1), F.lit("")), F.lit("GET")))
    routes_ = found.select("path", verb.alias("method"), F.regexp_extract("args", r'"([^"]*)"', 1).alias("tail"), "handler").join(kinds.select("path", "base", "kind", "name"), "path")
    serving = kinds.where("kind = 'class'").select(F.col("path").alias("controller_file"), F.explode(F.regexp_extract_all("rest", F.lit(r"(\w+)"), 1)).alias("name"), F.col("base").alias("outer"))
    own = routes_.where("kind = 'class'").select("path", "method", joined_url(F.col("base"), F.col("tail")).alias("url"), "handler", F.col("path").alias("controller_file"))
    lent = routes_.where("kind = 'interface'").join(serving, "name").select("path", "method", joined_url(F.coalesce(F.nullif("outer", F.lit("")), "base"), F.col("tail")).alias("url"), "handler", "controller_file")
    return own.union(lent)


def express(files: DataFrame) -> DataFrame:
    """path, method, url of routes of apps and routers; where one is mounted is a route of method USE. The first of a method and url stays."""
    found = each(of_kind(files, ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), r"(?i)\b(\w*(?:app|router|api|server|fastify|koa)\w*)\s*\.\s*(get|post|put|delete|patch|use)\s*\(\s*['\"`](/[^'\"`]*)['\"`]", "object", "verb", "url")
    return first_of(found.select("path", "at", F.upper("verb").alias("method"), F.regexp_replace("url", "(?<=.)/+$", "").alias("url")), ["method", "url"], "path", "at").drop("at")


def dotnet(files: DataFrame) -> DataFrame:
    """path, method, url, handler: every action of a controller, below its class's route."""
    parts = each(of_kind(files, ".cs"), r'\[Route\(\s*"([^"]*)"\s*\)\]|\bclass\s+(\w+)|\[\s*(?:[^\]\[]*?,\s*)?Http(Get|Post|Put|Delete|Patch)\s*(?:\(\s*"([^"]*)"\s*\))?\s*(?:,[^\]\[]*)?\]\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|async|virtual|override)\s+)+[\w<>,\[\].?]+\s+(\w+)\s*\(', "route", "class", "verb", "tail", "handler")
    w = Window.partitionBy("path").orderBy("at")
    held = parts.withColumn("owner", F.last(F.nullif("class", F.lit("")), ignorenulls=True).over(w)).withColumn("n", F.sum((F.col("class") != "").cast("int")).over(w))
    # A route before a class, and after the class before it, is that class's.
    base = held.where("route <> ''").groupBy("path", (F.col("n") + 1).alias("n")).agg(F.max_by("route", "at").alias("base"))
    acts = held.where("verb <> ''").join(base, ["path", "n"], "left")
    short = F.regexp_replace("owner", "Controller$", "")
    return acts.select("path", F.upper("verb").alias("method"), joined_url(F.replace(F.coalesce("base", F.lit("")), F.lit("[controller]"), short), F.col("tail")).alias("url"), F.concat_ws(".", "owner", "handler").alias("handler"))


def conflicts(found: DataFrame) -> DataFrame:
    """method, url that more than one place has."""
    return found.groupBy("method", "url").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")


# Frontends.

# What the beginning of a function's name says of its method; POST else.
VERBS = (("get", "GET"), ("query", "GET"), ("fetch", "GET"), ("list", "GET"), ("load", "GET"), ("post", "POST"), ("add", "POST"), ("create", "POST"), ("save", "POST"), ("update", "PUT"), ("put", "PUT"), ("delete", "DELETE"), ("del", "DELETE"), ("remove", "DELETE"), ("patch", "PATCH"))
_SCRIPTS = (".js", ".jsx", ".ts", ".tsx")


def inline_calls(files: DataFrame) -> DataFrame:
    """path, url, line of calls with a literal address; several on one line are one."""
    places = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = places.select("path", (F.col("line") + 1).alias("line"), F.regexp_extract_all("text", F.lit(sqltext.INLINE), 1).alias("urls")).where(F.size("urls") > 0)
    return found.select("path", F.regexp_replace(F.col("urls")[0], "/+$", "").alias("url"), "line")


def request_exports(files: DataFrame) -> DataFrame:
    """path, name, url, method: the request objects in exported functions; the second and later ones of a function are named by their line."""
    parts = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    owner = F.nullif(F.regexp_extract("text", r"export\s+(?:default\s+)?(?:async\s+)?(?:function|const|let)\s+(\w+)", 1), F.lit(""))
    w = Window.partitionBy("path").orderBy("line")
    held = parts.withColumn("own", owner).withColumn("function", F.last("own", ignorenulls=True).over(w)).withColumn("n", F.count("own").over(w)).where("function IS NOT NULL")
    bodies = held.groupBy("path", "function", "n").agg(F.min("line").alias("from"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    call = r"\b(?:request|fetch|axios|http)(?:<[^()]*>)?\s*\(\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
    found = bodies.select("path", "function", "from", "body", F.posexplode(F.regexp_extract_all("body", F.lit(call), 1)).alias("at", "object"))
    url = F.regexp_replace(F.regexp_extract("object", r"\burl\s*:\s*['\"`](/[^'\"`]*)['\"`]", 1), "/+$", "")
    said = F.upper(F.nullif(F.regexp_extract("object", r"\bmethod\s*:\s*['\"`](\w+)['\"`]", 1), F.lit("")))
    line = F.col("from") + 1 + F.size(F.split(F.expr("substring(body, 1, locate(object, body) - 1)"), "\n")) - 1
    rows = found.select("path", "function", "at", url.alias("url"), F.coalesce(said, method_of(F.col("function"))).alias("method"), line.alias("line")).where("url <> ''")
    nth = F.row_number().over(Window.partitionBy("path", "function").orderBy("at"))
    return rows.withColumn("nth", nth).select("path", F.when(F.col("nth") == 1, F.col("function")).otherwise(F.concat_ws("@", "function", F.col("line").cast("string"))).alias("name"), "url", "method")


def method_of(name: Column) -> Column:
    out = F.lit("POST")
    for start, verb in reversed(VERBS):
        out = F.when(F.startswith(F.lower(name), F.lit(start)), verb).otherwise(out)
    return out


def react_calls(files: DataFrame) -> DataFrame:
    """path, name, url, method of exported requests, then of calls with a literal address."""
    scripts = of_kind(files, ".ts", ".tsx")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return request_exports(scripts).union(inline_calls(scripts).select("path", F.concat(stem, F.lit("@"), F.col("line").cast("string")), "url", F.lit("POST")))


def react_pages(files: DataFrame, calls: DataFrame) -> DataFrame:
    """calls: name. page (a file), target (name): files that import a function of the services by name and call it."""
    text = of_kind(files, ".ts", ".tsx").where(F.contains("text", F.lit("services/apis")))
    names = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"(?s)import\s*\{([^}]*)\}\s*from\s*['\"][^'\"]*services/apis"), 1), lambda x: F.split(x, ",")))
    asked = text.select("path", "text", F.explode(F.transform(names, lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"(?s)\s+as\s+.*", ""), r"\s+", "")))).alias("target")).where("target <> ''")
    called = asked.where(F.expr(r"regexp_like(text, concat('\\b', target, '\\s*\\('))"))
    return called.join(calls.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select(F.col("path").alias("page"), "target").distinct()


def vue_components(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (path, name), one a file; calls (path, name, url, method) in them and in scripts."""
    parts = of_kind(files, ".vue")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    base = F.element_at(F.split("path", "/"), -1)
    both = of_kind(files, ".vue", *_SCRIPTS)
    inline = inline_calls(both).select("path", F.concat(base, F.lit("@"), F.col("line").cast("string")).alias("name"), "url", F.lit("POST").alias("method"))
    return parts.select("path", stem.alias("name")), request_exports(of_kind(files, *_SCRIPTS)).union(inline)


def vue_routes(files: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes (path, route, name), and which component (path, route, component) each renders: that of the identifier, else of the name."""
    entry = F.regexp_extract_all("text", F.lit(r"(?s)(\{\s*[^{}]*?\bpath\s*:\s*[`'\"][^`'\"]+[`'\"][^{}]*?\})"), 1)
    found = of_kind(files, *_SCRIPTS).select("path", F.posexplode(entry).alias("at", "e"))
    part = lambda pattern: F.nullif(F.regexp_extract("e", pattern, 1), F.lit(""))
    rows = found.select("path", "at", part(r"\bpath\s*:\s*[`'\"]([^`'\"]+)[`'\"]").alias("route"), part(r"\bname\s*:\s*[`'\"]([^`'\"]+)[`'\"]").alias("named"), part(r"\bcomponent\s*:\s*([A-Za-z_$][\w$]*)").alias("component"))
    kept = first_of(rows.where(F.startswith("route", F.lit("/")) | F.col("named").isNotNull() | F.col("component").isNotNull()), ["path", "route"], "at")
    stems = components.select("name").distinct()
    met = kept.join(stems.select(F.col("name").alias("component"), F.lit(True).alias("_a")), "component", "left").join(stems.select(F.col("name").alias("named"), F.lit(True).alias("_b")), "named", "left")
    drawn = met.select("path", "route", F.when(F.col("_a"), F.col("component")).when(F.col("_b"), F.col("named")).alias("component")).where("component IS NOT NULL")
    return kept.select("path", "route", F.coalesce("named", "route").alias("name")), drawn


_CONST = re.compile(r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*([^;]+);")


def resolve_constants(source: str, deepest: int = 6) -> Iterator[tuple[str, str]]:
    """name, value of the constants that are strings put together from strings and constants of the same file; others are left out."""
    said = {m[1]: [p.strip() for p in m[2].split("+")] for m in _CONST.finditer(source)}
    known: dict[str, str] = {}
    for _ in range(deepest + 1):
        now = {}
        for name, parts in said.items():
            values = [p[1:-1] if len(p) > 1 and p[0] == p[-1] and p[0] in "'\"`" else known.get(p) for p in parts]
            if name not in known and None not in values:
                now[name] = "".join(values)
        if not now:
            break
        known |= now
    yield from known.items()


def constants(files: DataFrame) -> DataFrame:
    return scan(of_kind(files, ".js", ".ts"), resolve_constants, "name string, value string")


def registry_path(value: Column) -> Column:
    """The path of an address without query, fragment, places of values, = and / at the end; empty if it is none of an API."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(value, r"(?s)[?#].*$", "")), r"\$?\{[^}]*\}", ""), "=+$", ""), "/+$", "")
    return F.when(bare.rlike("^/[A-Za-z]"), bare).otherwise("")


def url_registry(files: DataFrame, declared: list[str] | None = None, least: int = 8) -> DataFrame:
    """path, name, url: constants of the declared files, or of files with many addresses, that are addresses; their method is not known."""
    scripts = of_kind(files, ".js", ".ts")
    addresses = F.filter(F.regexp_extract_all("text", F.lit(r"['\"`]([^'\"`]*)['\"`]"), 1), lambda x: F.split_part(x, F.lit("?"), F.lit(1)).rlike("^/[A-Za-z]"))
    held = scripts.where(F.col("path").isin(declared)) if declared else scripts.where(F.size(addresses) >= least)
    return constants(held).select("path", "name", registry_path(F.col("value")).alias("url")).where("url <> ''")


def module_graph(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reports: root, json of a dependency tool. Modules (root, source), and imports (root, source, target) between modules of one report."""
    shape = "struct<modules: array<struct<source: string, dependencies: array<struct<resolved: string>>>>>"
    mods = reports.select("root", F.explode(F.from_json("json", shape)["modules"]).alias("m")).select("root", F.col("m.source").alias("source"), "m.dependencies").where("source IS NOT NULL")
    known = mods.select("root", F.col("source").alias("target")).distinct()
    edges = mods.select("root", "source", F.explode("dependencies").alias("d")).select("root", "source", F.col("d.resolved").alias("target")).join(known, ["root", "target"], "left_semi")
    return mods.select("root", "source").distinct(), edges.select("root", "source", "target").distinct()


# Calls.

#: Names that too many functions have to say anything.
GENERIC = ("get", "set", "add", "update", "delete", "append", "execute", "print", "str", "int", "len", "list", "dict")


def call_map(files: DataFrame) -> DataFrame:
    """caller, callee by bare names over all files; generic names are left out, and so are files that do not parse."""
    found = scan(of_kind(files, ".py"), sqltext.python_calls, "caller string, callee string")
    return found.where(~F.col("callee").isin(*GENERIC)).select("caller", "callee").distinct()


def reachable_names(calls: DataFrame, starts: DataFrame, max_depth: int = 6, most: int = 500) -> DataFrame:
    """starts: start. start, name: what is called from a name within some hops, for each start; no hop begins for a start once it has reached so many names. The start itself only if it is called again."""
    from functools import reduce

    from graphloom.operators.shared import cut

    frontier = cut(starts.select("start", F.col("start").alias("name")).distinct())
    out: list[DataFrame] = []
    for _ in range(max_depth):
        found = frontier.join(calls.select(F.col("caller").alias("name"), "callee"), "name").select("start", F.col("callee").alias("name")).distinct()
        if out:
            seen = reduce(DataFrame.union, out)
            found = found.join(seen, ["start", "name"], "left_anti").join(seen.groupBy("start").count().where(F.col("count") >= most).select("start"), "start", "left_anti")
        frontier = cut(found)
        if not frontier.limit(1).count():
            break
        out.append(frontier)
    return reduce(DataFrame.union, out) if out else frontier


def call_edges(endpoints: DataFrame, functions: DataFrame, calls: DataFrame, confidence: float, max_depth: int = 6) -> DataFrame:
    """endpoints: id, handler; functions: id, name. source, target: endpoints and the functions whose name their handler reaches."""
    reached = reachable_names(calls, endpoints.select(F.col("handler").alias("start")), max_depth)
    met = endpoints.select(F.col("id").alias("source"), F.col("handler").alias("start")).join(reached, "start").join(functions.select(F.col("id").alias("target"), "name"), "name")
    return met.select("source", "target").distinct().withColumn("confidence", F.lit(confidence))


def find_handlers(endpoints: DataFrame, symbols: DataFrame) -> DataFrame:
    """endpoints: id, handler, file; symbols: sid, name, file, ord. id, sid: the first symbol of the handler's name in its file, else the only one of that name."""
    met = endpoints.where("handler <> '' AND file <> ''").join(symbols.select("sid", F.col("name").alias("handler"), F.col("file").alias("at"), "ord"), "handler")
    per = met.groupBy("id").agg(F.min(F.when(F.col("at") == F.col("file"), F.struct("ord", "sid"))).alias("same"), F.count("*").alias("n"), F.min("sid").alias("only"))
    return per.select("id", F.coalesce("same.sid", F.when(F.col("n") == 1, F.col("only"))).alias("sid")).where("sid IS NOT NULL")


def bridge(endpoints: DataFrame, functions: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """functions: id, name, file; calls: source, target (of symbols). source, target, confidence: endpoints and the table-touching functions (by file and name) that their handler's calls reach within six hops."""
    starts = find_handlers(endpoints, symbols)
    walk = calls.select(F.col("source").alias("here"), F.col("target").alias("there")).distinct()
    from graphloom.operators.shared import cut

    frontier = cut(starts.select(F.col("sid").alias("from"), "sid").distinct())
    seen = frontier
    for _ in range(6):
        found = frontier.join(walk.withColumnRenamed("here", "sid"), "sid").select("from", F.col("there").alias("sid")).distinct()
        frontier = cut(found.join(seen, ["from", "sid"], "left_anti"))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    keyed = functions.groupBy("name", "file").agg(F.min_by("id", "ord").alias("target"))
    told = seen.join(symbols.select("sid", "name", "file"), "sid").join(keyed, ["name", "file"]).select(F.col("from").alias("sid"), "target")
    return starts.withColumnRenamed("id", "source").join(told, "sid").select("source", "target").distinct().withColumn("confidence", F.lit(0.7))
