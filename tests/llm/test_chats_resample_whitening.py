"""Whitening against numpy, resampling and chats against plain Python, and the edges of all three."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from graphloom.llm import chats, resample, whitening

FOLDER = Path("/root/testdata/sf0.001")

# --- chats -----------------------------------------------------------------------------------------------------------------------------------------

NASTY = [
    "", " ", "\\", "\\\\", "</turn>", "<\\/turn>", "</part>", "</turn>\n", "### user: ", "#### ", "###", "### ", "##\\# ", "<", "</", "</turn", "\n", ": ", "a\n</turn>\n### assistant: b", "\\</turn>\\", "\\\\### \\\\",
    "汉字 </turn> 𝒳 ### é", "</</turn>turn>", "\\### Assistant: </turn> ok",
]


def plain(turns):
    """What op13 returns of the turns (role, text) of a conversation."""
    out, before, n = "", None, 0
    esc = lambda s: re.sub(r"\\|(?<=<)/(?=(?:turn|part)>)|(?<=##)#(?= )", lambda m: "\\" + m[0], s)
    for role, text in turns:
        if role != before:
            out += ("</turn>\n" if n else "") + f"### {re.sub('(?<=:) ', lambda m: chr(92) + m[0], esc(role))}: "
        else:
            out += "</part>"
        out += esc(text)
        before, n = role, n + 1
    told, learnt = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return out + "</turn>\n", len(turns), hashlib.sha256(told.encode()).hexdigest(), learnt


def test_chats_are_read_back_from_what_was_written(spark):
    rows = []
    for c in range(3):
        rows += [(c, i, ("user", "assistant", "assistant", "system: x", "\\</turn>: ", ":", "")[(i * (c + 1) + i // 5) % 7], t) for i, t in enumerate(NASTY * (1 + 30 * (c == 2)))]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    made = {r.conv_id: r for r in chats.format_chats(df).withColumn("turns", chats.read_turns(chats.F.col("formatted"))).collect()}
    for c in range(3):
        turns = [(r, t) for k, _, r, t in rows if k == c]
        formatted, n, _, learnt = plain(turns)
        assert made[c].formatted == formatted
        assert [tuple(x) for x in made[c].turns] == turns and len(turns) == n
        under = [formatted[s.start : s.start + s.length] for s in made[c].loss]
        assert "".join(re.sub(r"(?s)\\(.)", r"\1", x) for x in under) == learnt
        assert len(under) == sum(r == "assistant" for r, _ in turns)


def test_chats_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, loss int, t string"
    rows = [(1, 1, "user", None, "x", 1, "y"), (1, None, None, "late", "x", 1, "y"), (1, 0, "assistant", "b", "x", 1, "y"), (1, 0, "assistant", "a", "x", 1, "y"), (1, 0, "assistant", "a", "x", 1, "y"), (None, 0, "user", "z" * 300_000, "x", 1, "y")]
    made = {r.conv_id: r for r in chats.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert made[1].formatted == "### assistant: a</part>a</part>b</turn>\n### user: </turn>\n### : late</turn>\n"
    assert made[1].loss == [(15, 1), (23, 1), (31, 1)]
    assert made[None].formatted == f"### user: {'z' * 300_000}</turn>\n" and made[None].loss == []
    assert chats.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_op13_has_the_rows_of_plain_python(spark, tmp_path):
    rows = [(5, i, r, t) for i, (r, t) in enumerate((r, t) for t in NASTY for r in ("user", "assistant"))] + [(6, 0, "user", None), (6, 1, "user", "é𝒳")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in chats.op13_chats(spark, str(tmp_path)).collect()}
    own = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    for conv, turns in {5: [(r, t) for c, _, r, t in rows if c == 5], 6: [("user", ""), ("user", "é𝒳")], -7: own}.items():
        formatted, n, told, learnt = plain(turns)
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (n, told, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted))
    assert len(found) == 3


# --- resampling ------------------------------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, d string, weight int, m int, part int"


def grams(text, runs):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def drawn(docs, target, runs=1, buckets=10_000):
    s, t = Counter(), Counter()
    for x in docs:
        s.update(g % buckets for g in grams(x[1], runs)[1])
    for x in target:
        t.update(g % buckets for g in grams(x, runs)[1])
    ns, nt, out = sum(s.values()), sum(t.values()), []
    for doc, text in docs:
        words, found = grams(text, runs)
        w = sum(math.floor(1000 * math.log((t[g % buckets] + 1) * (ns + buckets) / ((s[g % buckets] + 1) * (nt + buckets)))) for g in found)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = i + 1
    return Counter(map(repr, (r[:5] for r in out)))


def texts(n):
    rng = np.random.default_rng(1)
    words = ["a", "B", "Éa", "汉字" * 40, "x" * 23, "y" * 24, "z" * 25, "w9", "É"] + [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling_is_that_of_plain_python(spark, runs):
    docs = [*texts(120), *[(1000 + i, "the same text of many " * 9) for i in range(90)], (None, None), (7, ""), (8, "\x00.,"), (9, "long w1 " * 30_000), (None, "w1 w2 " * 20), (None, "w1 w2 " * 20)]
    df = spark.createDataFrame([(*d, "c", 1, 2, 3) for d in docs], DOCS).repartition(5)
    target = ["w1 w2 w3 w4 " * 5, None, "", "the same w7"]
    found = resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), runs=runs, buckets=10_000 if runs == 1 else 100_000)
    assert Counter(repr(list(r)) for r in found.collect()) == drawn(docs, target, runs, 10_000 if runs == 1 else 100_000)


def test_resampling_ties_go_to_the_smaller_id_and_repeats_stay(spark):
    docs = [(i % 50, "w " * 20) for i in range(200)]
    found = resample.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("w",)], "text string")).collect()
    assert Counter(repr(list(r)) for r in found) == drawn(docs, ["w"])
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 21))


def test_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resample.resampled(none, some).count() == 0
    assert [list(r) for r in resample.resampled(some, none).collect()] == [eval(x) for x in drawn([(1, "a " * 30)], [])]


@pytest.mark.parametrize("name", ["op12_resample", "op13_chats"])
@pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not here")
def test_query_has_the_rows_of_its_sql(spark, name):
    query, sql = {"op12_resample": (resample.op12_resample, resample.ORACLE), "op13_chats": (chats.op13_chats, chats.ORACLE)}[name]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert Counter(map(repr, (tuple(r[n] for n in names) for r in query(spark, str(FOLDER)).collect()))) == Counter(map(repr, want.fetchall()))


# --- whitening -------------------------------------------------------------------------------------------------------------------------------------


def check_whitening(spark, vectors, **how):
    """All rows against numpy's eigenvectors; vectors without ties among the first values."""
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    rows = whitening.whitened(df, **how).collect()
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, width = x.shape
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u, k = e[::-1], u[:, ::-1], min(8, width)
    assert len(rows) == n * k
    got = np.full((n, k), np.nan)
    for r in rows:
        if r.whitened is not None:
            got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.identity_error < 1e-9 and r.residual < 1e-11
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9
    d = ((n * x.astype(object) - x.astype(object).sum(0)) ** 2).sum(1)
    assert {(r.vec_id, r.deviation) for r in rows} == set(enumerate(d.tolist()))
    want = c @ u[:, :k] / np.sqrt(np.where(e[:k] > 1e-12 * e.sum(), e[:k], np.nan))
    sign = np.sign(np.nansum(got * want, axis=0))
    assert np.nanmax(np.abs(got - want * sign)) < 1e-6 and (np.isnan(got) == np.isnan(want)).all()
    return rows


def test_whitening_is_that_of_numpy(spark):
    rng = np.random.default_rng(3)
    check_whitening(spark, rng.standard_normal((400, 64)))  # flat
    check_whitening(spark, rng.standard_normal((300, 5)))  # fewer entries than components
    check_whitening(spark, rng.standard_normal((300, 40)) * np.geomspace(9, 1e-2, 40))  # steep
    check_whitening(spark, np.repeat(rng.standard_normal((300, 30)), [200, *[1] * 299], axis=0))  # a hot vector
    rows = check_whitening(spark, rng.standard_normal((500, 90)), block=8, most_columns=40)  # kept blocks are cut down
    assert rows[0].passes > 90 / 8 + 1


def test_whitening_of_few_dimensions_that_vary(spark):
    rng = np.random.default_rng(4)
    rows = check_whitening(spark, np.hstack([rng.standard_normal((200, 3)), np.ones((200, 20))]))
    assert {r.component: r.whitened is None for r in rows} == {c: c > 3 for c in range(1, 9)}


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(None, None), (1, []), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [1e35, 0.0])]
    good = [(7, [0.5, -0.25]), (7, [0.5, -0.25]), (None, [1.0, 3.0]), (9, [-2.0, 0.0])]
    df = spark.createDataFrame([(e, v, "c", 0) for v, e in bad + good], "embedding array<float>, vec_id long, x string, slot int")
    rows = whitening.whitened(df).collect()
    assert sorted((r.vec_id or -1, r.component) for r in rows) == sorted((v, c) for v in (7, 7, -1, 9) for c in (1, 2)) and {r.n for r in rows} == {4}
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_deviations_that_no_long_holds():
    m = np.array([[1 << 40, 0], [0, 1]])
    sums = m.astype(object).sum(0)
    assert whitening.deviations(m, 2, sums) == [None, None]
    m = np.array([[3_000_000_000, 1], [0, 0]])
    assert whitening.deviations(m, 2, m.astype(object).sum(0)) == [9 * 10**18 + 1] * 2
