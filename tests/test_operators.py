"""Operators on small inputs with known results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.measures import seconds
from graphloom.functions.sqltext import created_tables, split_columns
from graphloom.functions.text import chunks, html_to_text
from graphloom.operators.cleanse import dedup_edges, dedup_nodes, impact_graph
from graphloom.operators.community import components, louvain
from graphloom.operators.links import match_templates
from graphloom.operators.memory import context_plan, keyword_order, resolve_conflicts
from graphloom.operators.ranking import judged
from graphloom.operators.retrieval import rrf
from graphloom.operators.telemetry import percentile
from graphloom.operators.traverse import best_paths, distances, path_steps, reach, steps
from graphloom.sources.store import GraphStore
from graphloom.streaming.jobs import EMPTY, fold, step
from graphloom.streaming.limiter import accepted

EDGE = "source string, target string, kind string, confidence double, src string, ord long"


def edges(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDGE)


def chain(spark):
    return edges(spark, ("api", "end", "calls_api", 1.0, "ast"), ("end", "fn", "calls", 0.9, "ast"), ("fn", "table", "writes_table", None, None))


def test_impact_chain_reaches_all_from_the_table(spark):
    start = spark.createDataFrame([("table",)], "id string")
    found = {r.id: (r.depth, r.via_edge) for r in reach(steps(chain(spark), True), start).collect()}
    assert found == {"table": (0, None), "fn": (1, "writes_table"), "end": (2, "calls"), "api": (3, "calls_api")}


def test_first_discovery_wins_over_later_edges(spark):
    found = reach(steps(edges(spark, ("a", "b", "calls", 0.5, None), ("a", "b", "imports", 1.0, "ast")), False), spark.createDataFrame([("a",)], "id string"))
    assert found.where("id = 'b'").first().via_edge == "calls"


def test_best_path_prefers_quality_then_shortness(spark):
    e = edges(spark, ("x", "t", "calls", 0.5, "ast"), ("x", "y", "calls", 1.0, "ast"), ("y", "t", "calls", 1.0, "ast"))
    nodes = spark.createDataFrame([(x,) for x in "xyt"], "id string")
    found = {r.id: (round(r.score, 4), r.hops) for r in best_paths(path_steps(nodes, e), spark.createDataFrame([("t",)], "id string")).collect()}
    assert found == {"y": (0.9, ["y"]), "x": (0.81, ["y", "x"])}


def test_stamped_edge_beats_a_surer_one(spark):
    kept = dedup_edges(edges(spark, ("a", "b", "calls", 1.0, None), ("a", "b", "calls", 0.4, "ast"), ("a", "b", "calls", 0.6, "regex"))).first()
    assert (kept.src, kept.confidence) == ("regex", 0.6)


def test_weak_kind_yields_and_registry_edges_go(spark):
    nodes = spark.createDataFrame([("m", "frontend_module", False, 0), ("m", "frontend_component", False, 1), ("k", "frontend_api_call", True, 2)], "id string, kind string, url_registry boolean, ord long")
    assert {r.id: r.kind for r in dedup_nodes(nodes).collect()}["m"] == "frontend_component"
    _, kept = impact_graph(nodes, edges(spark, ("m", "k", "contains", 1.0, None), ("m", "k", "uses_api", 1.0, None)))
    assert [r.kind for r in kept.collect()] == ["uses_api"]


def test_two_triangles_are_two_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    found = louvain(spark.createDataFrame([("p", *x) for x in pairs], "project_id string, source string, target string"))
    assert {r.id: r.community for r in found.collect()} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d")}


def test_isolated_nodes_are_communities_and_ties_go_to_the_smaller_name(spark):
    edges_ = spark.createDataFrame([("p", "m", "z"), ("p", "m", "a"), ("p", "q", "q")], "project_id string, source string, target string")
    nodes = spark.createDataFrame([("p", x) for x in "amzqi"], "project_id string, id string")
    found = {r.id: r.community for r in louvain(edges_, nodes=nodes).collect()}
    assert found["i"] == "i" and found["q"] == "q" and found["a"] == found["m"] == "a"


def _grouped(links):
    """The method of operators.community in plain Python, move by move: each accepted move must gain at its turn."""
    import hashlib

    near, loop = {}, {}
    for x, y in links:
        if x != y:
            for u, v in ((x, y), (y, x)):
                near.setdefault(u, {})[v] = near.get(u, {}).get(v, 0.0) + 1
    place = {x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in near}
    member = {x: x for x in near}
    while True:
        d = {x: sum(near[x].values()) + loop.get(x, 0.0) for x in near}
        m2, of = sum(d.values()), {x: x for x in near}
        for k in range(60):
            r = 11 * k % 60
            order = {x: ((place[x] << r) | (place[x] >> (60 - r))) & ((1 << 60) - 1) for x in near}
            total = {c: sum(d[x] for x in near if of[x] == c) for c in set(of.values())}
            weight = {x: {of[x]: 0.0} for x in near}
            for x, row in near.items():
                for y, w in row.items():
                    weight[x][of[y]] = weight[x].get(of[y], 0.0) + w
            gain = lambda x, c, t: weight[x].get(c, 0.0) - (t[c] - (d[x] if of[x] == c else 0.0)) * d[x] / m2  # noqa: B023, E731
            best = {x: min(weight[x], key=lambda c: (-gain(x, c, total), c)) for x in near}  # noqa: B023
            asks = {x for x in near if best[x] != of[x] and gain(x, best[x], total) - gain(x, of[x], total) > 1e-9}
            if not asks:
                break
            movers = sorted((x for x in asks if not any(y in asks and (order[y], y) > (order[x], x) for y in near[x])), key=lambda x: (order[x], x), reverse=True)
            enters, leaves, told, now = {}, {}, [], dict(total)
            for x in movers:
                c, h = best[x], of[x]
                if weight[x].get(c, 0.0) - (total[c] + enters.get(c, 0.0)) * d[x] / m2 - (weight[x][h] - (total[h] - d[x] - leaves.get(h, 0.0)) * d[x] / m2) > 1e-9:
                    assert gain(x, c, now) > gain(x, h, now)
                    now[h] -= d[x]
                    now[c] += d[x]
                    told.append((x, c))
                enters[c], leaves[h] = enters.get(c, 0.0) + d[x], leaves.get(h, 0.0) + d[x]
            assert told
            of.update(told)
        least = {}
        for x in sorted(near):
            least.setdefault(of[x], x)
        of = {x: least[c] for x, c in of.items()}
        if len(set(of.values())) == len(near):
            return member
        member = {x: of[c] for x, c in member.items()}
        merged, inside = {c: {} for c in of.values()}, {}
        for x, row in near.items():
            inside[of[x]] = inside.get(of[x], 0.0) + loop.get(x, 0.0)
            for y, w in row.items():
                if of[x] == of[y]:
                    inside[of[x]] += w
                else:
                    merged[of[x]][of[y]] = merged[of[x]].get(of[y], 0.0) + w
        near, loop = merged, inside
        if len(near) == 1:
            return member


def _random_links(n, m, seed):
    import random

    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{min(rng.randrange(n), rng.randrange(n), rng.randrange(n))}") for _ in range(m)]


@pytest.mark.parametrize(("n", "m"), [(200, 300), (200, 1500), (60, 1700), (30, 20)])
def test_communities_are_those_of_plain_python(spark, n, m):
    links = {f"p{k}": _random_links(n, m, k) for k in range(3)}
    rows = [(p, *x) for p, found in links.items() for x in found]
    found = louvain(spark.createDataFrame(rows, "project_id string, source string, target string")).collect()
    assert {(r.project_id, r.id, r.community) for r in found} == {(p, x, c) for p, some in links.items() for x, c in _grouped(some).items()}


def test_communities_by_joins_are_the_same(spark, monkeypatch):
    from graphloom.operators import community

    monkeypatch.setattr(community, "TASK_PAIRS", 12)  # the first level of two projects by joins, the next in tasks
    links = {"a": _random_links(16, 26, 1), "b": [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(4) for j in range(i)] + [("a0", "b0"), ("b1", "c1")], "c": [("x", "y")]}
    rows = [(p, *x) for p, found in links.items() for x in found]
    found = louvain(spark.createDataFrame(rows, "project_id string, source string, target string")).collect()
    assert {(r.project_id, r.id, r.community) for r in found} == {(p, x, c) for p, some in links.items() for x, c in _grouped(some).items()}


def test_walks_stop_once_enough_is_visited(spark):
    walk = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(i, 10 + i) for i in range(1, 6)] + [(11, 100)], "here long, there long")
    start = spark.createDataFrame([(0,)], "id long")
    assert sorted(r.id for r in distances(walk, start, 10, 5).collect()) == [0, 1, 2, 3, 4, 5]
    assert {r.id: r.depth for r in distances(walk, start, 2).collect()} == {0: 0, **dict.fromkeys(range(1, 6), 1), **dict.fromkeys(range(11, 16), 2)}


@pytest.mark.parametrize("block", [1000, 3])
def test_nearest_vectors_in_blocks(spark, monkeypatch, block):
    import numpy as np

    from graphloom.operators import retrieval

    monkeypatch.setattr(retrieval, "FEW_QUERIES", block)
    v = np.random.default_rng(2).normal(size=(60, 8))
    v[7] = v[3]
    v[11] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    found = retrieval.cosine(rows, rows.where("vec_id < 10").selectExpr("vec_id AS q", "embedding AS v"), 5).collect()
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for q in range(10):
        s = np.round(unit @ unit[q], 9)
        assert [r.doc for r in sorted((r for r in found if r.q == q), key=lambda r: r.rank)] == sorted(range(60), key=lambda i: (-s[i], i))[:5]


def test_windows_of_lines():
    from graphloom.operators.analysis import windows_of

    lines = ["a" * 9, "b" * 30, "c" * 4, "d" * 4, "e" * 4]
    assert list(windows_of(lines, 20, 1)) == ["a" * 9, "b" * 20, "cccc\ndddd\neeee"]
    assert list(windows_of(["x"] * 5, 4, 5)) == ["x\nx"] * 4


def test_constants_need_all_their_parts():
    from graphloom.operators.lineage import resolve_constants

    deep = "const a0 = 'x';" + "".join(f"const a{i + 1} = a{i} + 'y';" for i in range(9))
    found = dict(resolve_constants(deep + "const z = unknown + 'x'; const f = g();"))
    assert found["a6"] == "xyyyyyy" and not {"z", "f", "a8"} & set(found)


def test_components_of_a_long_chain(spark):
    found = components(spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y")], "u string, v string"))
    assert {r.id: r.root for r in found.collect()} == {**{f"{i:03}": "000" for i in range(41)}, "x": "x", "y": "x"}


def test_templates_match_by_segments(spark):
    calls = spark.createDataFrame([(1, "GET /a/7/b?x=1"), (2, "/a/b"), (3, "/c/:id/")], "call int, url string")
    ends = spark.createDataFrame([("e1", "/a/{id}/b"), ("e2", "/a/b"), ("e3", "/c/9")], "endpoint string, template string")
    assert sorted((r.call, r.endpoint) for r in match_templates(calls, ends).collect()) == [(1, "e1"), (2, "e2"), (3, "e3")]


def memories(spark):
    rows = [(1, "personal", "t", False, None), (2, "org", "t", True, None), (3, "team", "t", True, None), (4, "org", None, False, "k"), (5, "project", None, False, None)]
    return spark.createDataFrame([(*r, "text", "o", i) for i, r in enumerate(rows)], "id long, scope string, topic_key string, is_redline boolean, task_id string, content string, org_id string, created_at long")


def test_redlines_win_topics_in_the_orgs_order(spark):
    assert sorted(r.id for r in resolve_conflicts(memories(spark), ["org_id"]).collect()) == [2, 4, 5]


def test_budget_never_drops_redlines(spark):
    kept = context_plan(memories(spark), ["org_id"], keyword_order(["text"], "k"), "k", budget=3)
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4]


def test_fusion_adds_reciprocal_ranks(spark):
    lanes = spark.createDataFrame([("q", "a", "x", 0), ("q", "a", "y", 1), ("q", "b", "y", 0)], "q string, lane string, ref string, rank int")
    assert [r.ref for r in rrf(lanes, limit=2).orderBy("rank").collect()] == ["y", "x"]


def test_judgements(spark):
    results = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "c", 2)], "q string, ref string, rank int")
    r = judged(results, spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "z")], "q string, ref string"), 2).where("q = 'q'").first()
    assert (r.recall, r.hit, r.precision, r.rr) == (0.5, True, 0.5, 0.5)


@pytest.mark.parametrize("n", [1, 2, 5, 20])
def test_percentile_is_the_nearest_rank(spark, n):
    values = [float(x) for x in random.Random(n).choices(range(9), k=n)]
    found = percentile(spark.createDataFrame([("k", v) for v in values], "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert [found.p50, found.p95] == [sorted(values)[round(p * (n - 1))] for p in (0.5, 0.95)]


def test_durations(spark):
    df = spark.createDataFrame([("30m",), ("2h",), ("90",), ("",)], "t string")
    assert [r[0] for r in df.select(seconds(F.col("t"))).collect()] == [1800.0, 7200.0, 90.0, None]


def test_limiter_counts_only_what_it_allowed(spark):
    df = spark.createDataFrame([("k", t, t) for t in (0, 1, 2, 9, 10, 11)], "key string, at long, event_id long")
    assert [r.allowed for r in accepted(df, 2, 10).orderBy("at").collect()] == [True, True, False, False, True, True]


def test_job_commands(spark):
    s = step(EMPTY, "enqueue", 1.0, None)
    s = step(s, "claim", 2.0, "a")
    assert step(s, "claim", 3.0, "b") == s
    s = step(s, "enqueue", 4.0, None)
    s = step(s, "ack", 5.0, "a")
    assert (s["status"], s["pending_since"], s["attempts"]) == ("done", 4.0, 1)
    rows = [("k", 1, "enqueue", 1.0, None), ("k", 2, "claim", 2.0, "a"), ("k", 3, "quarantine", 3.0, None), ("j", 1, "enqueue", 1.0, None)]
    found = {r.key: r for r in fold(spark.createDataFrame(rows, "key string, seq long, command string, at double, token string")).collect()}
    assert found["k"].quarantined and found["k"].status == "running" and found["j"].pending_since == 1.0


def test_store_replaces_by_plugin_and_publishes(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(x, "plugin string, id string, ord long, v int")
    store.replace("nodes", rows(("a", "1", 0, 1), ("b", "1", 1, 2)), ["id"])
    store.replace("nodes", rows(("a", "2", 0, 3), ("a", "2", 1, 4)), ["id"])
    assert sorted((r.plugin, r.id, r.v) for r in store.read("nodes").collect()) == [("a", "2", 4), ("b", "1", 2)]
    versions = [store.build("t", rows(("a", "1", 0, i))) for i in range(4)]
    store.publish("t", versions[0])
    assert store.published("t").first().v == 0
    store.publish("t", versions[1])
    assert store.published("t").first().v == 1
    store.collect_garbage("t", keep=1)
    assert store.published("t").first().v == 1


def test_chunks_and_pages(spark):
    text = "# A\nshort\n\n# B\n" + "\n\n".join("w" * 400 for _ in range(5))
    found = chunks(spark.createDataFrame([(1, text), (2, None)], "d long, t string"), "d", "t").where("chunk IS NOT NULL").orderBy("chunk_index").collect()
    assert found[0].chunk == "# A\nshort" and all(len(r.chunk) <= 1500 for r in found) and len(found) == 4
    html = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><!-- y -->c",)], "h string")
    assert html.select(html_to_text(F.col("h"))).first()[0] == "a & b c"


def test_ddl_scanner():
    assert list(created_tables("CREATE TABLE t (id int, key varchar(32), index int, KEY i (id), INDEX (id))")) == [("t", "id", "int"), ("t", "key", "varchar(32)"), ("t", "index", "int")]
    assert split_columns("a int, b decimal(10,2), c text default 'x,y'") == ["a int", "b decimal(10,2)", "c text default 'x,y'"]
    assert list(created_tables("CREATE TABLE x.T (id BIGINT, PRIMARY KEY (id));")) == [("t", "id", "bigint")]


@pytest.mark.parametrize("few", [0, 500])
def test_names_that_hold_a_term(spark, monkeypatch, few):
    import random

    from graphloom.operators import names

    monkeypatch.setattr(names, "FEW_GRAMS", few)
    rng = random.Random(5)
    made = ["".join(rng.choice("abA_é𝒳") for _ in range(rng.randrange(12))) for _ in range(300)] + ["aaaaaa", "aXa", "", None, "get_user", "get_user"]
    terms = ["a", "ab", "aa", "aaa", "aaaa", "aba", "é𝒳", "b_é𝒳", "get_user", "er", "zz", "zzz", "aaz", "", *{x.lower()[2:7] for x in made[:60]}]
    index = names.name_index(spark.createDataFrame([(x,) for x in made], "name string").repartition(3))
    found = {(r.term, r.low) for r in names.names_with(index, spark.createDataFrame([(x,) for x in terms], "term string")).collect()}
    assert found == {(t, x.lower()) for t in terms if t for x in made if x and t in x.lower()}


def test_block_bounds_lose_no_document_of_the_first_ones(spark, monkeypatch):
    import random

    from graphloom.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 20)
    monkeypatch.setattr(retrieval, "FIRST_BLOCKS", 1)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the"] * 9 + [f"w{j}" for j in range(30)]) for _ in range(rng.randrange(30))) + (" rare" * 3 if i % 97 == 0 else "")) for i in range(600)] + [(600, None), (601, "")]
    index = retrieval.text_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert index.n == 602 and index.blocks.where("term = 'the'").count() > 20 and index.blocks.agg({"n": "max"}).first()[0] < 60
    queries = spark.createDataFrame([(1, "rare"), (1, "the"), (2, "w3"), (2, "w4"), (3, "none"), (4, "the")], "q long, term string")
    whole = retrieval.bm25(index, queries).withColumn("score", retrieval.F.round("score", 6))
    some, report = retrieval.bm25_top(index, queries, 5)
    first = lambda df: sorted(map(tuple, retrieval.top(df, ["q"], 5, retrieval.F.desc("score"), "doc").collect()))
    assert first(some.withColumn("score", retrieval.F.round("score", 6))) == first(whole)
    told = {r.q: (r.blocks, r.read) for r in report.collect()}
    assert told[1][1] < told[1][0] / 2 and set(told) == {1, 2, 4}


@pytest.mark.parametrize("kind", ["clustered", "flat"])
def test_vector_index_finds_nine_of_ten_neighbours(spark, kind):
    import numpy as np

    from graphloom.operators.retrieval import cosine
    from graphloom.operators.vectors import nearest, vector_index

    rng = np.random.default_rng(8)
    e = rng.standard_normal((3000, 30)) + (6 * rng.standard_normal((40, 30))[rng.integers(0, 40, 3000)] if kind == "clustered" else 0)
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(e)], "vec_id long, embedding array<double>")
    index = vector_index(rows)
    asks = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS q", "embedding AS v")
    found = {(r.q, r.doc) for r in nearest(index, asks, 30).collect()}
    true = {(r.q, r.doc) for r in cosine(rows, asks, 30).collect()}
    assert index.lists.count() == 3000 and len(found) == len(true) == 900
    assert len(found & true) >= 0.9 * len(true)
    if kind == "clustered":
        assert index.probes < len(index.centres) / 2
    assert nearest(vector_index(rows.limit(0)), asks, 3).count() == 0


def test_words_of_runs_are_those_of_the_best_of_all_paths(spark):
    import math
    import random
    from itertools import product

    from graphloom.operators.segment import segment, split_unknown

    rng, signs = random.Random(4), "一丁七万丈三"
    freq = {"".join(rng.choice(signs[:5]) for _ in range(rng.choice([1, 2, 2, 3, 4]))): rng.randrange(1, 90) for _ in range(60)}
    freq.pop("一", None)
    runs = {"".join(rng.choice(signs[:5]) for _ in range(rng.randrange(1, 10))) for _ in range(80)}
    total = sum(freq.values())

    def path(run):
        best = None
        for marks in product([0, 1], repeat=len(run) - 1):
            cuts = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
            words = [run[a:b] for a, b in zip(cuts, cuts[1:])]
            if all(w in freq or len(w) == 1 for w in words):
                s = 0.0
                for w in reversed(words):
                    s = math.log(freq.get(w, 1)) - math.log(total) + s if w in freq else -math.log(total) + s
                best = max(best or (s, [], []), (s, [len(w) for w in words], words))
        return best[2]

    found = {r.run: r for r in segment(spark.createDataFrame([(r,) for r in [*runs, ""]], "run string"), spark.createDataFrame([*freq.items(), ("", 5), ("无", 0)], "word string, freq long")).collect()}
    assert set(found) == runs
    for run in runs:
        want = path(run)
        if all(w in freq for w in want):
            assert found[run].words == want
            assert found[run].found == [x for w in want for x in [w[i : i + k] for k in (2, 3) if len(w) > k for i in range(len(w) - k + 1) if w[i : i + k] in freq] + [w]]
        assert "".join(found[run].words) == run
    # A character that begins words, one that ends them, and one that stands alone.
    chars, moves = {("甲", "B"): 50, ("乙", "E"): 50, ("丙", "S"): 50}, {("B", "E"): 50, ("E", "B"): 20, ("E", "S"): 20, ("S", "B"): 20}
    assert split_unknown("甲乙丙甲乙", chars, moves) == ["甲乙", "丙", "甲乙"] and split_unknown("甲乙", {}, {}) == ["甲", "乙"]
    none = segment(spark.createDataFrame([("丈三",)], "run string"), spark.createDataFrame([], "word string, freq long")).collect()
    assert [r.words for r in none] == [["丈", "三"]]
