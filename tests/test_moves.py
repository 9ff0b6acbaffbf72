"""Rows that are shuffled: none for each pair of a query and what it may find."""

from __future__ import annotations

from collections.abc import Callable

import pytest

PARTS, ASKED = 900, 90


def moved(spark, run: Callable[[], list]) -> tuple[list, int]:
    """What run() returns, and how many rows its stages wrote for a shuffle."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def told() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = told()
    out = run()
    return out, told() - before


@pytest.fixture(scope="module")
def symbols(spark):
    """Symbols of one repository with three names."""
    kind, name = "CASE id % 2 WHEN 0 THEN 'class' ELSE 'import' END", "element_at(array('red_bolt', 'red_ring', 'old_ring'), CAST(id % 3 + 1 AS INT))"
    return spark.range(PARTS).selectExpr("'r0' AS repo", "concat('n', id) AS id", f"{kind} AS kind", f"{name} AS name", f"{name} AS qualified_name", "'' AS docstring", "'' AS signature", "'python' AS language", "'src/m.py' AS file_path", "id AS ord").localCheckpoint()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.range(ASKED).selectExpr("id AS q", "CASE id % 2 WHEN 0 THEN 'red bolt' ELSE 'ring' END AS text").localCheckpoint()


def test_full_text(spark, symbols, queries):
    from graphloom.operators.symbols import fts

    found, rows = moved(spark, lambda: fts(symbols, queries, "or", 4).collect())
    assert sorted((r.rank, r.id) for r in found if r.q == 2) == [(0, "n0"), (1, "n3"), (2, "n6"), (3, "n9")]
    # Of names of the same score the first symbols, whatever their name.
    assert sorted((r.rank, r.id) for r in found if r.q == 3) == [(0, "n1"), (1, "n2"), (2, "n4"), (3, "n5")]
    assert len(found) == 4 * ASKED and rows < PARTS * 5 < PARTS * ASKED / 10


@pytest.mark.parametrize("sets, cells", [(1, 7), (4000, 2_000_000)])
@pytest.mark.parametrize("mode", ["and", "or"])
def test_full_text_in_blocks_is_that_of_plain_python(spark, monkeypatch, mode, sets, cells):
    import math
    import random

    from graphloom.operators import symbols as ops

    monkeypatch.setattr(ops, "FEW_SETS", sets)
    monkeypatch.setattr(ops, "CELLS", cells)
    rng, vocabulary = random.Random(3), ["red", "redder", "bolt", "ring", "old", "x1"]
    made = [(f"r{i % 2}", f"n{i}", rng.choice(["class", "import"]), "_".join(rng.choice(vocabulary) for _ in range(rng.randrange(4))), rng.choice([None, "bolt ring"]), "python", i) for i in range(120)]
    asks = [(0, "red ring"), (1, "RED bolt red"), (2, "o"), (3, "none"), (4, ""), (5, None), (6, "ring red"), (7, "x1 red old")]
    table = spark.createDataFrame(made, "repo string, id string, kind string, name string, docstring string, language string, ord long").selectExpr("*", "name AS qualified_name", "'' AS signature").repartition(3)
    got = {(r.q, r.repo, r.id): (r.rank, r.score) for r in ops.fts(table, spark.createDataFrame(asks, "q long, text string"), mode, 5, ["class"]).collect()}
    want = {}
    for repo in ("r0", "r1"):
        held = {row: [w for x in (row[3], row[3], row[4] or "") for w in x.replace("_", " ").split()] for row in made if row[0] == repo}
        mean = sum(map(len, held.values())) / len(held)
        tf = lambda row, t: sum(w.startswith(t) for w in held[row])  # noqa: E731, B023
        for q, text in asks:
            scored, terms = [], set((text or "").lower().split())
            df = {t: sum(tf(row, t) > 0 for row in held) for t in terms}
            for row in held:
                met = [t for t in terms if tf(row, t)]
                if met and row[2] == "class" and (mode == "or" or len(met) == len(terms)):
                    weight = lambda t: max(math.log((len(held) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * tf(row, t) * 2.2 / (tf(row, t) + 1.2 * (0.25 + 0.75 * len(held[row]) / mean))  # noqa: E731, B023
                    scored.append((-round(sum(map(weight, met)), 9), row[6], row[1]))
            want |= {(q, repo, name): (rank, -score) for rank, (score, _, name) in enumerate(sorted(scored)[:5])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)


def test_templates_of_one_shape(spark):
    from graphloom.operators.links import match_templates

    calls, ends = spark.range(PARTS).selectExpr("id AS call", "'/p/1?x' AS url"), spark.range(ASKED).selectExpr("id AS endpoint", "CASE WHEN id % 2 = 0 THEN '/p/{id}' ELSE '/p/1' END AS template")
    found, rows = moved(spark, lambda: match_templates(calls.union(calls), ends).groupBy("endpoint").count().collect())
    assert sorted(tuple(r) for r in found) == [(i, PARTS) for i in range(ASKED)]
    # Each side's own rows by the two shapes, twice, and the counts of tasks.
    assert rows < 10 * PARTS < PARTS * ASKED / 5


@pytest.mark.parametrize("cells, handed, few", [(2_000_000, 500_000, 100_000), (50, 7, 60)])
def test_scores_of_documents(spark, monkeypatch, cells, handed, few):
    import math

    from graphloom.operators import retrieval

    for name, value in (("CELLS", cells), ("HANDED", handed), ("FEW_ROWS", few), ("BLOCK_DOCS", 200)):
        monkeypatch.setattr(retrieval, name, value)
    texts = ["red bolt", "red ring ring", "old ring", "", "none"]
    docs = spark.range(PARTS).selectExpr("concat('d', id) AS doc_id", f"element_at(array({', '.join(map(repr, texts))}), CAST(id % 5 + 1 AS INT)) AS text")
    index = retrieval.text_index(docs)
    asks = [(q, t) for q in range(ASKED) for t in (["red", "bolt", "bolt"] if q % 2 else ["ring", "absent"])]
    found, rows = moved(spark, lambda: retrieval.bm25(index, spark.createDataFrame(asks, "q long, term string")).groupBy("q", "doc").agg({"score": "sum"}).collect() if few < 100 else retrieval.bm25(index, spark.createDataFrame(asks, "q long, term string")).collect())
    part, mean = PARTS // 5, sum(len(t.split()) for t in texts) / 5
    df = {t: part * sum(t in x.split() for x in texts) for t in ("red", "bolt", "ring")}
    want = {}
    for q in range(ASKED):
        for i in range(PARTS):
            w = texts[i % 5].split()
            s = sum(math.log(1 + (PARTS - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in (("red", "bolt") if q % 2 else ("ring",)) if t in w)
            if s:
                want[q, f"d{i}"] = s
    got = {(r[0], r[1]): r[2] for r in found}
    assert len(found) == len(want) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert few < 100 or rows < 2 * PARTS < len(want) / 5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with many parts of four names."""
    import shutil
    from pathlib import Path

    given, out = Path("/root/testdata/sf0.001"), tmp_path_factory.mktemp("parts")
    if not given.exists():
        pytest.skip("the tables are not here")
    for p in given.glob("*.parquet"):
        if p.stem != "part":
            shutil.copy(p, out)
    part = spark.read.parquet(f"{given}/part.parquet").where("p_partkey = 0")
    name = "element_at(array('red bolt', 'Red ring', 'old ring', 'new gizmo'), CAST(id * 7 % 11 % 4 + 1 AS INT)) AS p_name"
    kinds = "concat('Brand#', id % 25) AS p_brand", "element_at(array('LARGE', 'RED', 'SMALL'), CAST(id % 3 + 1 AS INT)) AS p_type", "CAST(id % 50 + 1 AS INT) AS p_size", "CAST(id AS DOUBLE) AS p_retailprice"
    rows = spark.range(6000).selectExpr("id AS p_partkey", name, *kinds).select(part.columns)
    rows.coalesce(1).write.parquet(f"{out}/part.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["ret-12", "ret-11", "jn-33", "top-05", "jn-21", "ret-14", "jn-22", "ret-10", "ret-15", "top-07", "top-15", "agg-50", "ret-02-cjk", "flt-24"])
def test_queries_over_many_parts_of_few_names(spark, folder, name):
    import duckdb
    from pathlib import Path

    from graphloom.plans import registry
    from test_queries import rows

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want = con.execute(registry.ORACLES[name])
    columns, want = [c[0] for c in want.description], want.fetchall()

    def run() -> tuple[list[str], list]:
        found = registry.QUERIES[name](spark, folder)
        return found.columns, found.collect()

    (found, records), n = moved(spark, run)
    assert rows(found, records) == rows(columns, want)
    # 60 queries ask for names that 1,500 parts have each.
    assert n < 100_000
