"""Rules over paths, roles and scopes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.kinds import lookup

# Folders that are not indexed and a path that is all the same; names of secrets; ranks of roles and what actions need.
EXCLUDED, KEPT = ("archive", "node_modules", "__pycache__", "target"), ("archive/incidents/",)
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".keystore")
SECRET_NAMES = ("id_rsa", "id_dsa", "id_ecdsa", ".env", "credentials", ".npmrc", ".pypirc")
ROLES = {"viewer": 1, "member": 2, "admin": 3}
ACTIONS = {"read": 1, "recall": 1, "write": 2, "admin": 3}
PAGE_FILES = ("page.tsx", "page.jsx", "page.ts", "page.js")
# Categories of documents in the order of their rules (parts of a path, beginnings, ends), and modules by beginning.
CATEGORIES = (
    ("memory", ("docs/memory/",), (), ()),
    ("tooling_incident", ("docs/dev-evolution/incidents/", "docs/incidents/"), (), ()),
    ("dev_log", ("docs/dev-evolution/", "docs/log/", "docs/plans/"), (), ()),
    ("rule", ("/rules/",), (), ()),
    ("incident", ("/archive/incidents/", "/incident-", "daily-summary"), (), ()),
    ("design", ("roadmap", "/architecture/"), (), ()),
    ("operations", ("/operations/",), (), ()),
    ("skill", ("/skills/",), (), ()),
    ("claude_md", (), (), ("CLAUDE.md", "AGENTS.md")),
    ("tool_doc", (), ("tools/",), ()),
)
MODULES = (("apps/stock-admin-api/", "stock-admin-api"), ("apps/stock-admin-web/", "stock-admin-web"), ("web-ui/", "web-ui"), ("python/stock-pipeline/", "stock-pipeline"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def slashes(path: Column) -> Column:
    """Forward slashes, without ./ before them."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def category_of(path: Column) -> Column:
    p, out = F.replace(path, F.lit("\\"), F.lit("/")), F.lit("doc")
    for name, parts, starts, ends in reversed(CATEGORIES):
        hit = _any([F.contains(p, F.lit(x)) for x in parts] + [F.startswith(p, F.lit(x)) for x in starts] + [F.endswith(p, F.lit(x)) for x in ends])
        out = F.when(hit, name).otherwise(out)
    return out


def module_of(path: Column) -> Column:
    p, out = F.replace(path, F.lit("\\"), F.lit("/")), F.lit("platform")
    for start, name in MODULES:
        out = F.when(F.startswith(p, F.lit(start)), name).otherwise(out)
    return out


def is_excluded(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~_any([F.contains(p, F.lit(x)) for x in KEPT]) & F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, EXCLUDED)))


def is_secret(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    # A name that only begins with a dot has no suffix.
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return suffix.isin(*SECRET_SUFFIXES) | _any([F.contains(name, F.lit(x)) for x in SECRET_NAMES])


def is_test_path(path: Column) -> Column:
    """A Python test or the fixtures of some, by its own name, or anything below a folder of tests."""
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    by_name = (name == "conftest.py") | F.endswith(name, F.lit("_test.py")) | (F.startswith(name, F.lit("test_")) & F.endswith(name, F.lit(".py")))
    return by_name | F.arrays_overlap(folders, F.array(F.lit("test"), F.lit("tests")))


def is_page(path: Column) -> Column:
    """Files of pages and views folders, and the page files of an app folder."""
    return path.rlike("/(pages|views)/") | (F.contains(path, F.lit("/app/")) & F.element_at(F.split(path, "/"), -1).isin(*PAGE_FILES))


def role_allows(role: Column, action: Column) -> Column:
    """Whether a role's rank reaches what an action needs; unknown and missing ones never do."""
    has, need = lookup(role, ROLES, -1), lookup(action, ACTIONS, -1)
    return F.coalesce((has > 0) & (need > 0) & (has >= need), F.lit(False))


def access(via: Column, mode: Column, project: Column, project_org: Column, org: Column, every: Column, allowed: Column) -> Column:
    """(allowed, reason, advisory) of an identity on a project. Internal identities pass; without token mode all pass, as advice only; else a token is needed, a project, an org that
    fits (projects without one are public), and the project in the token's list."""
    say = lambda ok, reason, advisory=False: F.struct(F.lit(ok).alias("allowed"), F.lit(reason).alias("reason"), F.lit(advisory).alias("advisory"))
    token = F.coalesce(via == "token", F.lit(False))
    other = F.coalesce(F.nullif(project_org, F.lit("")).isNotNull() & ~F.coalesce(project_org.eqNullSafe(org), F.lit(False)), F.lit(False))
    return (
        F.when(F.coalesce(via == "internal", F.lit(False)), say(True, "internal")).when(~F.coalesce(mode == "token", F.lit(False)), say(True, "passthrough", True)).when(~token, say(False, "needs_token")).when(F.coalesce(project, F.lit("")) == "", say(False, "needs_project"))
        .when(other, say(False, "org_mismatch")).when(F.coalesce(every, F.lit(False)), say(True, "all_projects")).when(F.coalesce(F.array_contains(allowed, project), F.lit(False)), say(True, "in_allowlist")).otherwise(say(False, "not_in_allowlist"))
    )


def scope_writes(scope: Column, ref: Column, user: Column, org_role: Column, project_role: Column, teams: Column) -> Column:
    """Whether a member may write to a memory scope. teams: array of (team_id, role); the first entry of a team counts."""
    write = F.lit("write")
    mine = F.try_element_at(F.filter(teams, lambda x: x["team_id"] == ref), F.lit(1))
    own = F.coalesce((ref == user) & (ref != "") & (user != ""), F.lit(False))
    return F.when(scope == "personal", own).when(scope == "project", role_allows(project_role, write)).when(scope == "org", role_allows(org_role, write)).when(scope == "team", role_allows(mine["role"], write)).otherwise(F.lit(False))


#: What tells a dialect in lower-cased text: words, ends of words, and phrases once blanks are single and those around brackets and equal signs are gone.
DIALECTS = (
    ("postgres", ("serial", "bigserial", "jsonb"), (), ("nextval(",)),
    ("mysql", (), ("unsigned",), ("auto_increment", "engine=")),
    ("sqlite", ("autoincrement",), (), ("without rowid",)),
)


def _any_ends(words: Column, end: str) -> Column:
    return F.exists(words, lambda x: F.endswith(x, F.lit(end)))


def dialect_of(text: Column, file: Column) -> Column:
    """The dialect that a file's name tells, else the first that its text tells; a cast by two colons is Postgres, too."""
    name = F.lower(file)
    marks = F.split(name, "[._-]")
    by_name = F.when(F.contains(name, F.lit(".sqlite")), "sqlite").when(F.contains(name, F.lit("mysql")), "mysql").when(F.contains(name, F.lit("postgres")) | F.array_contains(marks, "pg"), "postgres")
    low = F.lower(text)
    words, flat = F.split(low, "[^a-z0-9_]+"), F.regexp_replace(F.regexp_replace(low, r"\s+", " "), " ?([=(]) ?", "$1")
    casts = F.exists(F.slice(F.split(flat, "::"), 2, 1 << 30), lambda rest: rest.rlike("^[a-z0-9_]"))
    told = F.lit(None).cast("string")
    for dialect, whole, ends, phrases in reversed(DIALECTS):
        signs = [F.array_contains(words, w) for w in whole] + [_any_ends(words, e) for e in ends] + [F.contains(flat, F.lit(x)) for x in phrases]
        told = F.when(_any(signs + [casts] * (dialect == "postgres")), dialect).otherwise(told)
    return F.coalesce(by_name, told, F.lit("unknown"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** is any path, * anything but a slash, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if glob[i] in r"\.+()[]{}^$|" else "") + glob[i], i + 1
    return f"^{out}$"
