"""Plans of rules over paths, roles, scopes and tags. Paths are made of the parts: one of a few shapes, and a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.functions.measures import redact
from graphloom.functions.sqltext import is_constraint
from graphloom.functions.text import html_to_text, is_test
from graphloom.plans.registry import query
from graphloom.sources.tables import Tables, with_derived

SHAPES = (
    "docs/memory/m{}.md", "docs/dev-evolution/incidents/i{}.md", "docs/plans/roadmap-{}.md", "x/rules/r{}.md", "x/archive/incidents/a{}.md", "web-ui/roadmap{}.md", "a/operations/o{}.md", "a/skills/s{}/page.tsx", "tools/CLAUDE.md", "tools/t{}.md",
    "apps/stock-admin-api/src/{}_test.py", "apps/stock-admin-web/app/p{}/page.tsx", "python/stock-pipeline/tests/x{}.py", "a/node_modules/b{}.js", "archive/b{}.js", "web-ui/src/pages/p{}.vue", "src/test_{}.py", "src/conftest.py", "k/id_rsa{}.txt", "k/{}.pem", "k/.env", ".key", "src/x{}.spec.ts", "target/{}.class", "src/views/v{}.vue", "my/app/p{}/layout.tsx",
)
_PATHS = "p AS (SELECT p_partkey, replace([" + ", ".join(f"'{x}'" for x in SHAPES) + f"][1 + p_partkey % {len(SHAPES)}], '{{}}', CAST(p_partkey AS STRING)) AS path FROM part)"


def paths(t: Tables) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("p_partkey") % len(SHAPES) + 1).cast("int"))
    return t.part.select("p_partkey", F.replace(shape, F.lit("{}"), F.col("p_partkey").cast("string")).alias("path"))


def _by_shape(values: dict[int, str], default: str, column: str) -> str:
    """What the rule says of each shape, told one by one."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in values.items())
    return f"SELECT p_partkey, CASE p_partkey % {len(SHAPES)} {cases} ELSE {default} END AS {column} FROM part"


@query("scl-08", _by_shape({0: "'memory'", 1: "'tooling_incident'", 2: "'dev_log'", 3: "'rule'", 4: "'incident'", 5: "'design'", 6: "'operations'", 7: "'skill'", 8: "'claude_md'", 9: "'tool_doc'"}, "'doc'", "category"))
def categories(t: Tables) -> DataFrame:
    return paths(t).select("p_partkey", rules.category_of(F.replace("path", F.lit("/"), F.lit("\\"))).alias("category"))


@query("scl-09", _by_shape({10: "'stock-admin-api'", 11: "'stock-admin-web'", 12: "'stock-pipeline'", 5: "'web-ui'", 15: "'web-ui'"}, "'platform'", "module"))
def modules(t: Tables) -> DataFrame:
    return paths(t).select("p_partkey", rules.module_of(F.col("path")).alias("module"))


@query("flt-18", _by_shape({10: "true", 12: "true", 16: "true", 17: "true"}, "false", "test"))
def test_paths(t: Tables) -> DataFrame:
    return paths(t).select("p_partkey", rules.is_test_path(F.col("path")).alias("test"))


@query("flt-19", _by_shape({13: "true", 14: "true", 23: "true"}, "false", "excluded"))
def excluded_paths(t: Tables) -> DataFrame:
    return paths(t).select("p_partkey", rules.is_excluded(F.col("path")).alias("excluded"))


@query("flt-20", _by_shape({11: "true", 15: "true", 24: "true"}, "false", "page"))
def pages(t: Tables) -> DataFrame:
    return paths(t).select("p_partkey", rules.is_page(F.col("path")).alias("page"))


@query("flt-28", _by_shape({18: "true", 19: "true", 20: "true"}, "false", "secret"))
def secrets(t: Tables) -> DataFrame:
    """The file .key is all name and has no suffix."""
    return paths(t).select("p_partkey", rules.is_secret(F.col("path")).alias("secret"))


@query("flt-14", with_derived(f"WITH {_PATHS} ".replace("WITH ", ", ", 1) + "SELECT id, starts_with(name, 'test_') OR contains(file_path, '/tests/') OR ends_with(file_path, '_test.py') OR ends_with(file_path, '.spec.ts') AS test FROM symbols UNION ALL SELECT path || CAST(p_partkey AS STRING), p_partkey % 26 IN (10, 12, 22) FROM p", "symbols"))
def test_code(t: Tables) -> DataFrame:
    """A name or a file in capitals counts as well."""
    found = t.symbols.select("id", is_test(F.upper("name"), F.upper("file_path")).alias("test"))
    return found.union(paths(t).select(F.concat("path", F.col("p_partkey").cast("string")), is_test(F.lit(None).cast("string"), F.col("path"))))


@query("src-12", f"WITH {_PATHS} SELECT DISTINCT path FROM p WHERE (regexp_full_match(path, '(.*/)?[^/]*[.]md') OR regexp_full_match(path, 'src/[^/]*[.]py')) AND NOT (p_partkey % 26 IN (13, 14, 23))")
def discovery(t: Tables) -> DataFrame:
    """Files that a glob has and no excluded folder holds, each once."""
    wanted = [rules.glob_pattern(g) for g in ("**/*.md", "src/*.py")]
    hit = F.col("path").rlike(wanted[0]) | F.col("path").rlike(wanted[1])
    return paths(t).where(hit & ~rules.is_excluded(F.col("path"))).select("path").distinct()


@query("scl-46", f"WITH {_PATHS} SELECT p_partkey, CASE WHEN ends_with(path, '.md') AND starts_with(path, 'docs/') THEN 'chroma' WHEN ends_with(path, '.py') THEN 'codegraph' END AS scope FROM p WHERE (ends_with(path, '.md') AND starts_with(path, 'docs/')) OR ends_with(path, '.py')")
def scope_classes(t: Tables) -> DataFrame:
    """Changed paths by the globs of each index; a path of none is left out."""
    scope = F.when(F.col("path").rlike(rules.glob_pattern("docs/**/*.md")), "chroma").when(F.col("path").rlike(rules.glob_pattern("**/*.py")), "codegraph")
    return paths(t).select("p_partkey", scope.alias("scope")).where("scope IS NOT NULL")


@query("flt-09", f"WITH {_PATHS} SELECT p_partkey FROM p WHERE p_partkey % 26 = 8")
def where_builder(t: Tables) -> DataFrame:
    """'all' and blanks are no condition."""
    wanted = {"category": "claude_md", "module": "all"}
    named = paths(t).select("p_partkey", rules.category_of(F.col("path")).alias("category"), rules.module_of(F.col("path")).alias("module"))
    for column, value in wanted.items():
        if value not in ("", "all"):
            named = named.where(F.col(column) == value)
    return named.select("p_partkey")


@query("flt-29", f"WITH {_PATHS} SELECT 'category' AS relax, count(*) AS n FROM p WHERE starts_with(path, 'apps/stock-admin-web/') UNION ALL SELECT 'module', count(*) FROM p WHERE p_partkey % 26 = 0 UNION ALL SELECT 'both', count(*) FROM p")
def filter_miss(t: Tables) -> DataFrame:
    """What each relaxation of two conditions that find nothing together would find."""
    named = paths(t).select(rules.category_of(F.col("path")).alias("category"), rules.module_of(F.col("path")).alias("module"))
    a, b = F.col("category") == "memory", F.col("module") == "stock-admin-web"
    none = named.where(a & b).isEmpty()
    every = named.select(F.explode(F.array(F.when(b, "category"), F.when(a, "module"), F.lit("both"))).alias("relax")).where("relax IS NOT NULL")
    return every.groupBy("relax").agg(F.count("*").alias("n")).where(F.lit(none))


_ROLE = "['viewer', 'member', 'admin', 'owner', NULL]"


@query("flt-23", f"SELECT c_custkey, coalesce(CASE role WHEN 'viewer' THEN action IN ('read', 'recall') WHEN 'member' THEN action IN ('read', 'recall', 'write') WHEN 'admin' THEN action IN ('read', 'recall', 'write', 'admin') ELSE false END, false) AS allowed FROM (SELECT c_custkey, {_ROLE}[1 + c_custkey % 5] AS role, ['read', 'recall', 'write', 'admin', 'fly'][1 + c_custkey // 5 % 5] AS action FROM customer)")
def role_allows(t: Tables) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ("viewer", "member", "admin", "owner", None))), (F.col("c_custkey") % 5 + 1).cast("int"))
    action = F.element_at(F.array(*map(F.lit, ("read", "recall", "write", "admin", "fly"))), (F.floor(F.col("c_custkey") / 5) % 5 + 1).cast("int"))
    return t.customer.select("c_custkey", rules.role_allows(role, action).alias("allowed"))


@query("flt-21", """WITH a AS (SELECT c_custkey AS k, ['internal', 'token', 'anon', NULL, 'token', 'token'][1 + c_custkey % 6] AS via, CASE WHEN c_custkey % 11 = 0 THEN 'passthrough' ELSE 'token' END AS mode, CASE WHEN c_custkey % 7 > 0 THEN 'p' || CAST(c_custkey % 7 AS STRING) END AS project, CASE WHEN c_custkey % 4 > 0 THEN 'o' || CAST(c_custkey % 2 AS STRING) END AS porg, 'o' || CAST(c_custkey // 4 % 2 AS STRING) AS org, c_custkey % 9 = 0 AS every FROM customer)
SELECT k AS c_custkey, reason IN ('internal', 'passthrough', 'all_projects', 'in_allowlist') AS allowed, reason, reason = 'passthrough' AS advisory FROM (SELECT k, CASE WHEN via = 'internal' THEN 'internal' WHEN mode <> 'token' THEN 'passthrough' WHEN via IS NULL OR via <> 'token' THEN 'needs_token' WHEN project IS NULL THEN 'needs_project' WHEN porg IS NOT NULL AND porg <> org THEN 'org_mismatch' WHEN every THEN 'all_projects' WHEN project IN ('p1', 'p2') THEN 'in_allowlist' ELSE 'not_in_allowlist' END AS reason FROM a)""")
def access_decision(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    via = F.element_at(F.array(*map(F.lit, ("internal", "token", "anon", None, "token", "token"))), (k % 6 + 1).cast("int"))
    project, project_org = F.when(k % 7 > 0, F.concat(F.lit("p"), (k % 7).cast("string"))), F.when(k % 4 > 0, F.concat(F.lit("o"), (k % 2).cast("string")))
    org = F.concat(F.lit("o"), (F.floor(k / 4) % 2).cast("string"))
    said = rules.access(via, F.when(k % 11 == 0, "passthrough").otherwise("token"), project, project_org, org, k % 9 == 0, F.array(F.lit("p1"), F.lit("p2")))
    return t.customer.select("c_custkey", said.alias("d")).select("c_custkey", "d.*")


@query("flt-22", """WITH m AS (SELECT c_custkey AS k, ['personal', 'project', 'org', 'team', 'moon'][1 + c_custkey % 5] AS scope, CASE c_custkey // 5 % 3 WHEN 0 THEN 'u1' WHEN 1 THEN 't1' ELSE 't2' END AS ref, ['viewer', 'member', NULL][1 + c_custkey // 15 % 3] AS role FROM customer)
SELECT k AS c_custkey, CASE scope WHEN 'personal' THEN ref = 'u1' WHEN 'project' THEN coalesce(role = 'member', false) WHEN 'org' THEN coalesce(role <> 'viewer', false) WHEN 'team' THEN ref = 't1' ELSE false END AS allowed FROM m""")
def scope_write(t: Tables) -> DataFrame:
    """A user u1 who is a member of team t1, a viewer of team t2, and of changing roles elsewhere."""
    k = F.col("c_custkey")
    scope = F.element_at(F.array(*map(F.lit, ("personal", "project", "org", "team", "moon"))), (k % 5 + 1).cast("int"))
    ref = F.element_at(F.array(*map(F.lit, ("u1", "t1", "t2"))), (F.floor(k / 5) % 3 + 1).cast("int"))
    role = F.element_at(F.array(*map(F.lit, ("viewer", "member", None))), (F.floor(k / 15) % 3 + 1).cast("int"))
    teams = F.array(*(F.struct(F.lit(a).alias("team_id"), F.lit(b).alias("role")) for a, b in (("t1", "member"), ("t2", "viewer"))))
    return t.customer.select("c_custkey", rules.scope_writes(scope, ref, F.lit("u1"), role, role, teams).alias("allowed"))


@query("set-07", with_derived("SELECT DISTINCT org_id, owner, scope, ref FROM (SELECT org_id, owner, 'org' AS scope, 'org' AS ref FROM memories UNION ALL SELECT org_id, owner, 'project', scope_ref FROM memories WHERE scope = 'project' UNION ALL SELECT org_id, owner, 'personal', owner FROM memories)", "memories"))
def default_scopes(t: Tables) -> DataFrame:
    """Org, project and person, without any list of members; a missing part is left out."""
    project = F.when(F.col("scope") == "project", F.col("scope_ref"))
    pair = lambda s, r: F.struct(F.lit(s).alias("scope"), r.alias("ref"))
    every = F.filter(F.array(pair("org", F.lit("org")), pair("project", project), pair("personal", F.col("owner"))), lambda x: x["ref"].isNotNull())
    return t.memories.select("org_id", "owner", F.explode(every).alias("s")).select("org_id", "owner", "s.*").distinct()


@query("set-05", "SELECT o_custkey, l_partkey AS file FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def changed_union(t: Tables) -> DataFrame:
    """The files that any commit (order) of a push (customer) added, modified or removed, each once, as rows."""
    commits = t.lineitem.groupBy("l_orderkey").agg(*(F.collect_list(F.when(F.col("l_linenumber") % 3 == i, F.col("l_partkey"))).alias(c) for i, c in enumerate(("added", "modified", "removed"))))
    files = F.explode(F.array_union(F.array_union("added", "modified"), "removed")).alias("file")
    return commits.select("l_orderkey", files).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "file").distinct()


@query("set-02", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def result_merge(t: Tables) -> DataFrame:
    """Two results put together as they are: what both have is there twice."""
    one = t.orders.select(F.col("o_orderkey").alias("id"))
    return one.unionByName(one.where("id % 2 = 0")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("scl-07", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE 'see ' || CAST(page_id AS STRING) || chr(10) || 'a & b' END AS text FROM pages")
def doc_text(t: Tables) -> DataFrame:
    """A page's text if the file is a page, else the file as it is."""
    page = F.concat(F.lit("<p>see "), F.col("page_id").cast("string"), F.lit("</p><style>x</style>\n<b>a &amp; b</b>"))
    even = F.col("page_id") % 2 == 0
    rows = t.pages.select("page_id", F.when(even, "x.md").otherwise("x.HTML").alias("file"), F.when(even, F.col("html")).otherwise(page).alias("raw"))
    return rows.select("page_id", F.when(F.lower("file").rlike(r"\.html?$"), html_to_text(F.col("raw"))).otherwise(F.col("raw")).alias("text"))


@query("scl-42", "SELECT p_partkey, ['sqlite', 'mysql', 'postgres', 'postgres', 'postgres', 'mysql', 'sqlite', 'unknown'][1 + p_partkey % 8] AS dialect FROM part")
def dialects(t: Tables) -> DataFrame:
    files = ("a.sqlite.sql", "mysql_init.sql", "postgres.sql", "init-pg.sql", "page.sql", "b.sql", "c.sql", "d.sql")
    texts = ("", "x serial", "", "engine=x", "id BIGSERIAL", "a int UNSIGNED", "id integer AUTOINCREMENT", "create table t (a int)")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", rules.dialect_of(pick(texts), pick(files)).alias("dialect"))


@query("flt-27", "SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 5, 6) AS yes FROM part")
def constraint_segments(t: Tables) -> DataFrame:
    """key and index are names of columns, unless a list of columns follows; quoted ones always are."""
    parts = ("PRIMARY KEY (a)", "key idx_a (a, b)", "INDEX (a)", "key varchar(32)", "index int", "Fulltext (a)", "constraint c check (a > 0)", "`unique` int")
    segment = F.element_at(F.array(*map(F.lit, parts)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", is_constraint(segment).alias("yes"))


@query("flt-31", "SELECT event_id, '<redacted:len=' || CAST(length(event_type) AS STRING) || ':' || substr(sha256(event_type), 1, 8) || '>' AS a, CASE WHEN event_id % 2 = 0 THEN '<redacted:len=0>' END AS b FROM events")
def redacted_arguments(t: Tables) -> DataFrame:
    args = F.transform_values(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.when(F.col("event_id") % 2 == 0, "")), lambda k, v: redact(v))
    return t.events.select("event_id", args.alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("scl-14", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_brand ELSE NULL END AS repo, CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE 'moon::' || p_name END AS local FROM part")
def tag_resolve(t: Tables) -> DataFrame:
    """A known tag names the repository of what follows; with an unknown one the value stays as it is."""
    known = t.part.select(F.col("p_brand").alias("tag")).distinct().withColumn("repo", F.col("tag"))
    value = F.concat_ws("::", F.when(F.col("p_partkey") % 3 < 2, F.col("p_brand")).otherwise("moon"), "p_name")
    rows = t.part.select("p_partkey", value.alias("value")).withColumn("tag", F.when(F.contains("value", F.lit("::")), F.split_part("value", F.lit("::"), F.lit(1))))
    return rows.join(known, "tag", "left").select("p_partkey", "repo", F.when(F.col("repo").isNotNull(), F.substring(F.col("value"), F.length("tag") + 3, F.length("value"))).otherwise(F.col("value")).alias("local"))


@query("scl-15", """WITH RECURSIVE b AS (SELECT s_suppkey // 40 AS p, s_suppkey % 40 AS k, s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'api' WHEN 2 THEN 'web-2' WHEN 3 THEN 'web' ELSE 'job' || CAST(s_suppkey AS STRING) END AS base FROM supplier),
r AS (SELECT DISTINCT p, CAST(-1 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS tag FROM b UNION ALL SELECT r.p, r.nk, CASE WHEN r.nk = 0 THEN r.used ELSE r.used || [t] END, CASE WHEN r.nk = 0 THEN '' ELSE t END FROM (SELECT r.p, r.k + 1 AS nk, used, CASE WHEN list_contains(used, b2.base) THEN b2.base || '-' || CAST((SELECT min(i) FROM range(2, 100) x(i) WHERE NOT list_contains(used, b2.base || '-' || CAST(i AS STRING))) AS STRING) ELSE b2.base END AS t FROM r JOIN b b2 ON b2.k = r.k + 1 AND b2.p = r.p) r)
SELECT s_suppkey, tag FROM r JOIN b USING (p, k)""")
def stable_tags(t: Tables) -> DataFrame:
    """The main repository of a project has no tag; the others that of their folder, with the least number from 2 that is free where it is taken. The repositories of a project are few and go through one task; projects are spread."""
    from graphloom.operators.repos import stable_tags as tags

    base = F.when(F.col("s_suppkey") % 5 == 0, "web").when(F.col("s_suppkey") % 5 == 1, "api").when(F.col("s_suppkey") % 5 == 2, "web-2").when(F.col("s_suppkey") % 5 == 3, "web").otherwise(F.concat(F.lit("job"), F.col("s_suppkey").cast("string")))
    repos = t.supplier.select(F.floor(F.col("s_suppkey") / 40).cast("string").alias("project"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("/repos/"), base).alias("path"))
    return tags(repos).select(F.col("ord").alias("s_suppkey"), "tag")


_FRONT = "kind LIKE 'frontend%'"


@query("scl-16", with_derived(f", m AS (SELECT DISTINCT id FROM nodes WHERE {_FRONT}) SELECT e.ord, CASE WHEN e.source IN (SELECT id FROM m) THEN 'web::' || e.source ELSE e.source END AS source, CASE WHEN e.target IN (SELECT id FROM m) THEN 'web::' || e.target ELSE e.target END AS target FROM edges e WHERE e.kind IN ('calls_api', 'uses_api')", "nodes", "edges"))
def localise(t: Tables) -> DataFrame:
    """The frontend nodes of a repository get its tag, and the edges' ends with them."""
    from graphloom.operators.repos import localise as local

    return local(t.nodes, t.edges.where("kind IN ('calls_api', 'uses_api')"), "web")[1].select("ord", "source", "target")


@query("scl-17", with_derived("SELECT id, file, 'web' AS repo, file AS local FROM nodes WHERE kind = 'frontend_api_call'", "nodes"))
def unlocalise(t: Tables) -> DataFrame:
    from graphloom.operators.repos import localise as local

    tagged = local(t.nodes.where("kind = 'frontend_api_call'"), t.edges.limit(0), "web")[0]
    part = lambda i: F.split_part("file", F.lit("::"), F.lit(i))
    return tagged.select(F.regexp_replace("id", "^web::", "").alias("id"), part(2).alias("file"), part(1).alias("repo"), part(2).alias("local"))


@query("scl-29", with_derived("SELECT ord, 'ast' AS src, CASE WHEN ord % 2 = 0 THEN kind END AS kept FROM edges", "edges"))
def stamp(t: Tables) -> DataFrame:
    """Provenance is set in the description of an edge; its other entries stay."""
    meta = F.when(F.col("ord") % 2 == 0, F.to_json(F.struct(F.col("kind").alias("note"), F.struct(F.lit("old").alias("src")).alias("prov"))))
    held = F.coalesce(F.from_json(meta, "map<string, string>"), F.create_map().cast("map<string, string>"))
    rest = F.map_filter(held, lambda k, v: k != "prov")
    new = F.map_concat(rest, F.create_map(F.lit("prov"), F.to_json(F.struct(F.lit("ast").alias("src"), F.lit("py").alias("parser")))))
    return t.edges.select("ord", new.alias("m")).select("ord", F.get_json_object(F.col("m")["prov"], "$.src").alias("src"), F.col("m")["note"].alias("kept"))



@query("top-08", "SELECT p_size, n, total, total > 20 AS truncated FROM (SELECT p_size, count(*) AS n, min(p_partkey) AS m, count(*) OVER () AS total FROM part GROUP BY p_size) ORDER BY n DESC, p_size LIMIT 20")
def community_list(t: Tables) -> DataFrame:
    """The largest communities, how many there are, and whether some are left out."""
    sizes = t.part.groupBy("p_size").agg(F.count("*").alias("n"))
    total = sizes.agg(F.count("*").alias("total"))
    return sizes.orderBy(F.desc("n"), "p_size").limit(20).crossJoin(F.broadcast(total)).select("p_size", "n", "total", (F.col("total") > 20).alias("truncated"))


@query("win-03", "WITH g AS (SELECT p_size, min(p_partkey) AS m, count(*) AS n FROM part GROUP BY p_size HAVING count(*) >= 2), k AS (SELECT p_size, p_type, count(*) AS c, min(p_partkey) AS f FROM part GROUP BY ALL) SELECT g.p_size, 'community-' || CAST(row_number() OVER (ORDER BY m) - 1 AS STRING) AS name, n, (SELECT p_type FROM k WHERE k.p_size = g.p_size ORDER BY c DESC, f LIMIT 1) AS dominant, (SELECT string_agg(p_name, ',' ORDER BY p_partkey) FROM (SELECT p_name, p_partkey FROM part p WHERE p.p_size = g.p_size ORDER BY p_partkey LIMIT 5)) AS sample FROM g")
def group_rank(t: Tables) -> DataFrame:
    """Communities of two members or more, numbered by their smallest member: size, the commonest kind (of several the one met first), and the names of five members."""
    from graphloom.operators.repos import numbered

    groups = t.part.groupBy("p_size").agg(F.min("p_partkey").alias("m"), F.count("*").alias("n")).where("n >= 2")
    kinds = t.part.groupBy("p_size", "p_type").agg(F.count("*").alias("c"), F.min("p_partkey").alias("f"))
    dominant = kinds.groupBy("p_size").agg(F.max_by("p_type", F.struct("c", (-F.col("f")).alias("f"))).alias("dominant"))
    few = t.part.withColumn("rn", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))).where("rn <= 5")
    sample = few.groupBy("p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "p_name"))), lambda x: x["p_name"]), ",").alias("sample"))
    ranked = numbered(groups, "m")
    return ranked.join(dominant, "p_size").join(sample, "p_size").select("p_size", F.concat(F.lit("community-"), F.col("number").cast("string")).alias("name"), "n", "dominant", "sample")


@query("win-06", "WITH f AS (SELECT s_suppkey AS k, s_nationkey AS file, s_suppkey * 7 % 90 AS lo, s_suppkey * 7 % 90 + 1 + s_suppkey % 60 AS hi FROM supplier), l AS (SELECT p_partkey, p_partkey % 25 AS file, p_partkey * 3 % 160 AS line FROM part) SELECT l.p_partkey, (SELECT k FROM f WHERE f.file = l.file AND lo <= line AND line <= hi ORDER BY lo DESC, k LIMIT 1) AS owner FROM l")
def range_owner(t: Tables) -> DataFrame:
    """The function whose lines hold a line, the one that starts last; ranges are cut into tens, so that the join has equal keys."""
    lo = F.col("s_suppkey") * 7 % 90
    ranges = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("file"), lo.alias("lo"), (lo + 1 + F.col("s_suppkey") % 60).alias("hi"))
    ranges = ranges.withColumn("ten", F.explode(F.sequence(F.floor(F.col("lo") / 10), F.floor(F.col("hi") / 10))))
    lines = t.part.select("p_partkey", (F.col("p_partkey") % 25).alias("file"), (F.col("p_partkey") * 3 % 160).alias("line")).withColumn("ten", F.floor(F.col("line") / 10))
    met = lines.join(ranges, ["file", "ten"]).where("lo <= line AND line <= hi").groupBy("p_partkey").agg(F.min(F.struct((-F.col("lo")).alias("lo"), "s_suppkey")).alias("m"))
    return t.part.select("p_partkey").join(met, "p_partkey", "left").select("p_partkey", F.col("m.s_suppkey").alias("owner"))


@query("scl-40", "SELECT p_brand, sha256('{\"m\":[' || string_agg('[\"' || p_type || '\",\"' || p_name || '\",' || CAST(p_partkey AS STRING) || ']', ',' ORDER BY p_partkey) || '],\"sig\":\"v1\"}') AS fp FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 40 GROUP BY p_brand")
def fingerprint(t: Tables) -> DataFrame:
    """Of what a cluster's request holds, at most 40 members in their order, and of the labeler's signature."""
    few = t.part.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("rn <= 40")
    member = F.concat(F.lit('["'), "p_type", F.lit('","'), "p_name", F.lit('",'), F.col("p_partkey").cast("string"), F.lit("]"))
    per = few.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("rn", member.alias("m")))).alias("ms"))
    text = F.concat(F.lit('{"m":['), F.array_join(F.transform("ms", lambda x: x["m"]), ","), F.lit('],"sig":"v1"}'))
    return per.select("p_brand", F.sha2(text, 256).alias("fp"))
