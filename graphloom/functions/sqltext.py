"""Expressions and small scanners over SQL and source text."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"([`\"\[]?\w[\w.`\"\[\]]*)"
WRITES = rf"(?i)\b(?:insert\s+(?:or\s+\w+\s+)?into|update(?:\s+only)?|delete\s+from)\s+{_NAME}"
READS = rf"(?i)\b(?:from|join)\s+{_NAME}"
# Words that a table name is not; words that begin a constraint, and words that begin one only if a list of columns follows.
KEYWORDS = ("select", "dual", "where", "set", "values", "table", "only", "lateral")
CONSTRAINTS, INDEXES = ("primary", "foreign", "constraint", "unique", "check", "fulltext", "spatial"), ("key", "index")


def bare_name(name: Column) -> Column:
    """Lower-cased, without quoting and schema."""
    return F.lower(F.element_at(F.split(F.regexp_replace(name, r'["`\[\]]', ""), r"\."), -1))


def plausible_table(name: Column) -> Column:
    return ~F.lower(name).isin(*KEYWORDS) & ~name.rlike(r"^[0-9]+$") & (F.length(name) >= 2)


def tables_of(sql: Column, pattern: str) -> Column:
    names = F.transform(F.regexp_extract_all(sql, F.lit(pattern), 1), bare_name)
    return F.array_distinct(F.filter(names, plausible_table))


def table_access(sql: Column) -> tuple[Column, Column]:
    """Tables that a statement writes and reads; one it writes is no read."""
    writes = tables_of(sql, WRITES)
    return writes, F.array_except(tables_of(sql, READS), writes)


def split_columns(body: str) -> list[str]:
    """Parts between commas outside brackets and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            parts.append(body[start:i])
            start = i + 1
    return [p.strip() for p in (*parts, body[start:]) if p.strip()]


_CREATE = re.compile(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\(")
#: An index's list of columns comes after a blank or right after the word; a type's length comes right after the type.
CONSTRAINT = rf"(?i)^\s*(?:(?:{'|'.join(CONSTRAINTS)})\b|(?:{'|'.join(INDEXES)})(?:\s*\(|\s+\w+\s+\())"


def is_constraint(segment: Column) -> Column:
    """Whether a part of a table's body is a constraint and no column."""
    return segment.rlike(CONSTRAINT)


def table_body(sql: str, at: int) -> str | None:
    """What stands between the bracket at a place and the one that closes it; none if nothing does."""
    depth, quote = 0, ""
    for end in range(at, len(sql)):
        c = sql[end]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            depth += {"(": 1, ")": -1}.get(c, 0)
            if not depth:
                return sql[at + 1 : end]
    return None


_COLUMN = re.compile(r"(?s)^([`\"\[]?)([\w$]+)[`\"\]]?\s+(\w+(?:\s*\([^)]*\))?)")


def table_columns(body: str) -> list[tuple[str, str]]:
    """Name and type of each column of a body; a quoted name is never a constraint, a repeated one counts once."""
    out: dict[str, str] = {}
    for part in split_columns(body):
        m = _COLUMN.match(part)
        if m and (m[1] or not re.match(CONSTRAINT, part)):
            out.setdefault(m[2].lower(), re.sub(r"\s+", "", m[3]).lower())
    return list(out.items())


def created_tables(sql: str) -> Iterator[tuple[str, str, str]]:
    """table, column, type of each CREATE TABLE whose bracket is closed."""
    for m in _CREATE.finditer(sql):
        body = table_body(sql, m.end() - 1)
        if body is not None:
            table = re.sub(r'["`\[\]]', "", m[1]).split(".")[-1].lower()
            for name, kind in table_columns(body):
                yield table, name, kind


_HTTP = ("get", "post", "put", "delete", "patch")


def python_routes(source: str) -> Iterator[tuple[str, str, str, int]]:
    """method, url, handler, line of functions with a route decorator; a router's prefix is put before."""
    if not (tree := _parsed(source)):
        return
    prefix = {n.targets[0].id: _text(k.value) for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name) and _called(n.value) == "APIRouter" for k in n.value.keywords if k.arg == "prefix"}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in _HTTP and d.args and _text(d.args[0]) is not None:
                    yield d.func.attr.upper(), (prefix.get(getattr(d.func.value, "id", "")) or "") + _text(d.args[0]), node.name, node.lineno


_VERB = re.compile(r"(?i)\s*(insert|update|delete|select|replace|with)\b")


def _parsed(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError):
        return None


def _functions(tree: ast.Module) -> Iterator[tuple[ast.AST, list[ast.AST]]]:
    """Each function, and what stands in it but not in a function inside; None is the module itself."""
    todo: list[tuple[ast.AST | None, list[ast.AST]]] = [(None, list(tree.body))]
    while todo:
        owner, inside = todo.pop()
        held: list[ast.AST] = []
        while inside:
            node = inside.pop()
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                todo.append((node, list(node.body)))
                inside += node.decorator_list
            else:
                held.append(node)
                inside += ast.iter_child_nodes(node)
        yield owner, held


def python_statements(source: str) -> Iterator[tuple[str, str]]:
    """The innermost function (none: of the module), and the text of each string constant that begins as SQL does."""
    for owner, held in _functions(tree) if (tree := _parsed(source)) else ():
        for x in held:
            if isinstance(x, ast.Constant) and isinstance(x.value, str) and _VERB.match(x.value):
                yield owner.name if owner else None, x.value


def _called(node: ast.AST) -> str | None:
    return getattr(node.func, "attr", getattr(node.func, "id", None)) if isinstance(node, ast.Call) else None


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def core_tables(source: str) -> Iterator[tuple[str, str, str, str]]:
    """variable, table, column, type of Table("name", ..., Column("c", Type), ...) that is assigned."""
    for node in ast.walk(tree) if (tree := _parsed(source)) else ():
        if isinstance(node, ast.Assign) and _called(node.value) == "Table" and node.value.args and isinstance(node.targets[0], ast.Name):
            table = _text(node.value.args[0])
            for c in node.value.args[1:] if table else ():
                if _called(c) == "Column" and c.args and _text(c.args[0]):
                    kind = c.args[1] if len(c.args) > 1 else None
                    yield node.targets[0].id, table.lower(), _text(c.args[0]).lower(), _called(kind) or getattr(kind, "id", getattr(kind, "attr", None)) if kind is not None else None


#: Builders of statements, and what they do with the table that is their first argument.
BUILDERS = {"select": "reads_table", "join": "reads_table", "outerjoin": "reads_table", "select_from": "reads_table", "insert": "writes_table", "update": "writes_table", "delete": "writes_table", "upsert": "writes_table"}


def core_statements(source: str) -> Iterator[tuple[str, str, str]]:
    """function, variable, access: the names that builders of statements get in a function, through names of its own; t.c.x and t.insert() stand for t."""
    for owner, held in _functions(tree) if (tree := _parsed(source)) else ():
        if owner is None:
            continue
        alias = {n.targets[0].id: n.value.id for n in held if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name) and isinstance(n.value, ast.Name)}
        for node in held:
            access = BUILDERS.get(_called(node) or "")
            if access:
                for x in [*node.args, *([node.func.value] if isinstance(node.func, ast.Attribute) else [])]:
                    while isinstance(x, ast.Attribute):
                        x = x.value
                    if isinstance(x, ast.Name):
                        yield owner.name, alias.get(x.id, x.id), access


def python_calls(source: str) -> Iterator[tuple[str, str]]:
    """function, callee by bare name."""
    for owner, held in _functions(tree) if (tree := _parsed(source)) else ():
        for node in held if owner is not None else ():
            if _called(node):
                yield owner.name, _called(node)


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def python_models(source: str) -> Iterator[tuple[str, str, str]]:
    """class, table, column of models: __tablename__ with Column fields; or a models.Model with *Field fields, whose table is Meta.db_table or the class's name in snake case."""
    for node in ast.walk(tree) if (tree := _parsed(source)) else ():
        if isinstance(node, ast.ClassDef):
            fields = [(s.targets[0].id, s.value) for s in node.body if isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Name)]
            declared = next((_text(v) for n, v in fields if n == "__tablename__"), None)
            columns = [n for n, v in fields if _called(v) == "Column"]
            django = [n for n, v in fields if (_called(v) or "").endswith("Field")]
            base = any(isinstance(b, ast.Attribute) and b.attr == "Model" and getattr(b.value, "id", "") == "models" for b in node.bases)
            if declared and columns:
                yield from ((node.name, declared.lower(), c) for c in columns)
            elif django and base:
                named = [_text(s.value) for m in node.body if isinstance(m, ast.ClassDef) and m.name == "Meta" for s in m.body if isinstance(s, ast.Assign) and getattr(s.targets[0], "id", "") == "db_table"]
                table = (named[0] if named and named[0] else _CAMEL.sub("_", node.name)).lower()
                yield from ((node.name, table, c) for c in django)


#: By kind of file: patterns of endpoints with groups method and url.
EXPRESS = r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]"
SPRING = r"@(Get|Post|Put|Delete|Patch)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]+)\""
DOTNET = r"\[Http(Get|Post|Put|Delete|Patch)\(\s*\"([^\"]+)\"\s*\)\]"
#: A call with a literal address; its method is not told apart.
INLINE = r"(?:axios|fetch|request)\s*(?:\.\s*(?:get|post|put|delete|patch))?\s*\(\s*[`'\"]\s*(/[\w\-/:{}.]+)"


def endpoints(text: Column, pattern: str) -> Column:
    """Structs of method and url, in order."""
    methods, urls = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.zip_with(methods, urls, lambda m, u: F.struct(F.upper(m).alias("method"), u.alias("url")))


def groups(text: Column, pattern: str, *names: str) -> Column:
    """Structs of the groups of each match of a pattern, in order."""
    found = [F.regexp_extract_all(text, F.lit(pattern), i + 1) for i in range(len(names))]
    return F.transform(F.arrays_zip(*(f.alias(n) for f, n in zip(found, names, strict=True))), lambda x: F.struct(*(x[n].alias(n) for n in names)))
