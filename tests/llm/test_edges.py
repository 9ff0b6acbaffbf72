"""Crafted inputs: strings that defeat polynomial hashes, texts longer than a block, limits of rows, ties, empty side tables, and
operators and pipeline against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import archives, decontaminate, licenses, lm_score, mixture, near_copies, quality, simhash, suffix_dedup, token_files, toxicity
from graphloom.llm import _text as texts_of
from tests.llm.test_llm import ALNUM, DOC, LEXICON, SPACE, by_id, fingerprint, hits, low, prose, without_repeats


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(a if x else b for x in bits[:n])


@pytest.mark.parametrize("pair", ["Xj", "ab", "qz"])
def test_lines_that_collide_are_not_repeats(spark, pair):
    one, two = thue_morse(1024, *pair), thue_morse(1024, *pair[::-1])
    buf = np.frombuffer(f"{one}\n{two}\n".encode(), np.uint8)
    assert len(set(texts_of.hash_ranges(buf, np.array([0, 1025]), np.array([1024, 2049])).tolist())) == 1  # so the input is what it should be
    rows = [(1, f"{one}\n{two}\n"), (2, f"{one}\n{two}\n{one}\n")]
    found = by_id(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(found[k].n_dup_lines, found[k].dup_line_chars) for k in (1, 2)] == [(0, 0), (1, 1024)]


def test_classes_are_those_of_bytes():
    rng = random.Random(4)
    words = [bytes(rng.choices(b"ab", k=rng.randint(0, 5))) for _ in range(3000)] + [thue_morse(1024, "a", "b").encode(), thue_morse(1024, "b", "a").encode()] + [b"long" * 3000] * 3
    buf, ends = np.frombuffer(b" ".join(words) + b" ", np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
    found = texts_of.classes(buf, ends - [len(w) for w in words], ends).tolist()
    assert len(set(zip(words, found, strict=True))) == len(set(words)) == len(set(found))


def test_words_that_collide_are_not_near_copies(spark):
    one, two = thue_morse(1024, "X", "j"), thue_morse(1024, "j", "X")
    around = prose(4, 5)
    rows = [(1, one), (2, two), (3, f"{around} {one}"), (4, f"{around} {two}"), (5, one.lower()), (6, two)]
    found = by_id(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [found[k].component_id for k in range(1, 7)] == [1, 2, 3, 4, 1, 2]


@pytest.mark.parametrize("few", [0, 1000])
def test_one_of_each_group_stays_however_many_go(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_GONE", few)
    rows = [(5, "a b c d"), (2, "a b c d"), (2, "e f g h"), (2, "a b c d"), (None, "a b c d"), (None, None), (7, ""), (None, "p q r s")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), groups=near_copies.near_copies).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(2, "a b c d"), (2, "e f g h"), (7, ""), (None, "p q r s")])


@pytest.mark.parametrize("pair", ["Xj", "kw"])
@pytest.mark.parametrize("few", [512, 0])
def test_strings_that_collide_stay(spark, pair, few):
    common = "".join(random.Random(1).choices("abcdefgh ", k=144))
    rows = [(1, common + thue_morse(256, *pair)), (2, common + thue_morse(256, *pair[::-1])), (3, thue_morse(3000, *pair)), (4, "y" * 700), (5, "ab" * 300 + "c" + "ab" * 300)]
    found = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), few=few))
    assert {k: tuple(r)[1:5] for k, r in found.items()} == without_repeats({k: t.encode() for k, t in rows}, 400)


def test_a_common_passage_in_many_texts(spark):
    """All sides of the comparison of large runs: inside, across its edges, and with part of the surroundings in common."""
    rng, passage = random.Random(2), prose(100, 77)
    rows = []
    for i in range(60):
        left, right = prose(rng.randint(0, 40), 1000 + i), prose(rng.randint(0, 40), 2000 + i)
        if i % 5 == 0:
            left = f"{left} {prose(25, 3000 + i % 3)}"
        if i % 4 == 0:
            right = f"{prose(30, 4000 + i % 2)} {right}"
        rows.append((i, f"{left} {passage[rng.randint(0, 120) : len(passage) - rng.randint(0, 120)]} {right}"))
    want = without_repeats({k: t.encode() for k, t in rows}, 400)
    assert sum(x[1] for x in want.values()) > 10_000
    for few in (0, 5, 512):
        found = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), few=few))
        assert {k: tuple(r)[1:5] for k, r in found.items()} == want


BIG = prose(260_000, 90)


def test_texts_longer_than_a_block(spark):
    assert len(BIG.encode()) > texts_of.MAX_BLOCK
    docs = spark.createDataFrame([(1, BIG), (2, "a short one"), (3, BIG + " licensed under the Apache license, version 2.0. "), (4, None)], "doc_id long, text string")
    words = BIG.encode().split()
    assert [by_id(quality.quality_rules(docs))[k].n_words for k in (1, 2, 4)] == [len(words), 3, 0]
    prints = by_id(simhash.near_duplicates(docs))
    assert prints[1].fp % 2**64 == fingerprint(BIG) and prints[3].component_id == 1
    item = b" ".join(words[200_000:200_015]).decode()
    found = by_id(decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")))
    assert [found[k].n_hit for k in (1, 2, 3, 4)] == [15, 0, 15, 0]
    scored = by_id(lm_score.score_documents(docs, spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")))
    assert scored[1].n_tokens == len(ALNUM.findall(low(BIG))) and scored[1].score < 0 and scored[4].score is None
    tokens = by_id(token_files.token_files(docs, tokenizer=None))
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(BIG, add_special_tokens=False).ids, 1]
    assert (tokens[1].start, tokens[1].n_tokens, tokens[1].ids_crc32) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and tokens[2].start == len(ids)
    assert [len(r.licenses) for _, r in sorted(by_id(licenses.scan_licenses(docs)).items())] == [0, 0, 1, 0]
    chain = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int"), {"toxic": F.col("toxic") == 1})
    assert toxicity.classify(docs, chain).where("p_toxic BETWEEN 0 AND 1").count() == 4


def test_losses_of_many_short_texts(spark, monkeypatch):
    """A block holds 65,535 texts at most, as they are numbered by 16 bits."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["w"] * 150_000})
    assert [len(b) for b in texts_of.blocks(iter([batch]), "text", lm_score.BLOCK, lm_score.BLOCK_TEXTS)] == [65_535, 65_535, 18_930]
    found = lm_score.score_documents(spark.range(140_000).selectExpr("id AS doc_id", "concat('w', id % 7) AS text").coalesce(1), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert found.where("n_tokens = 1").count() == 140_000 and found.select("doc_id").distinct().count() == 140_000


def test_contexts_that_are_frequent_late_are_spread(spark):
    rows = [(i, prose(20, i)) for i in range(300)] + [(300 + i, "late " * 200) for i in range(60)]
    hot, total = lm_score.frequent(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    b = np.frombuffer(b"late", np.uint8)
    late = int(texts_of.hash_ranges(b, np.array([0]), np.array([4]))[0] >> texts_of.U64(64 - lm_score.BITS))
    assert late in hot.tolist() and total == sum(len(ALNUM.findall(low(t))) for _, t in rows)


def test_empty_side_tables(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    assert [r.n_items for r in decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()] == [0, 0]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert by_id(lm_score.score_documents(docs, none))[1].target_loss == pytest.approx(math.log(lm_score.CLASSES), rel=1e-6)
    assert [r.toxic for r in toxicity.classify(docs, toxicity.train(docs, none, {"toxic": F.col("toxic") == 1})).collect()] == [False, False]


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert archives.op7_arc_to_warc(spark, str(tmp_path)).count() == 0


def test_no_row_is_mixed_more_than_twice(spark):
    rows = [(i, prose(30, i) if i % 4 else "", "en", "abc"[i % 3], 0) for i in range(200)] + [(500, "only one here", "en", "d", 0), (501, " ", "en", "d", 0), (502, None, "en", "d", 0)]
    docs = spark.createDataFrame(rows, DOC)
    times = Counter(r.doc_id for r in mixture.mix_rows(docs).collect())
    assert max(times.values()) == 2 and times[500] == 2


def test_rows_without_an_id_are_mixed_one_by_one(spark):
    rows = [(None, prose(30, i), "en", "ab"[i % 2], 0) for i in range(400)]
    found = mixture.mixture(spark.createDataFrame(rows, DOC))
    for r in found.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 60


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = (prose(60, 900 + i) for i in range(3))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x"), (3, b, "y"), (None, c, "x"), (None, c, "x"), (7, None, "x"), (None, None, "x"), (2, c + " tail", "z")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, d string"), groups=simhash.near_duplicates)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    # c and its longer copy are of one group only if their fingerprints are near; brute force says which.
    near = (fingerprint(c) ^ fingerprint(c + " tail")).bit_count() <= 2
    assert got == Counter([(1, a), (2, b), (7, None), (2, c + " tail"), *([] if near else [(None, c)])]) and kept.columns == ["doc_id", "text", "d"]


def plain_fit(rows, earlier, y, classes_used):
    """fit() of the toxicity chain by loops over rows and words."""
    n, positive = len(y), sum(y)
    count = {w: [0, 0] for w in classes_used}
    for words, bad in zip(rows, y, strict=True):
        for w in words:
            count[w][bad] += 1
    ratio = {w: math.log((b + 1) / (positive + 2)) - math.log((a + 1) / (n - positive + 2)) for w, (a, b) in count.items() if a + b >= toxicity.LEAST_DOCS}
    ratio = {w: r for w, r in ratio.items() if r}
    size = [math.sqrt(sum(ratio.get(w, 0) ** 2 for w in words)) + 1e-9 for words in rows]
    ordered = sorted(size)
    middle = (n - 1) / 2
    scale = ordered[math.floor(middle)] + (ordered[math.ceil(middle)] - ordered[math.floor(middle)]) * (middle - math.floor(middle))
    x = [{w: ratio[w] / scale for w in words if w in ratio} for words in rows]
    z = [[v / 4 for v in e] + [1.0] for e in earlier]
    step = 4.0 / (1 + max(0, sum(sum(v * v for v in r.values()) for r in x) / n + sum(sum(v * v for v in r) for r in z) / n))
    w, v = dict.fromkeys(ratio, 0.0), [0.0] * len(z[0])
    mw, mv, last = dict(w), list(v), None
    for k in range(toxicity.STEPS * 4):
        g = []
        for a, b, bad in zip(x, z, y, strict=True):
            s = sum(mw[i] * q for i, q in a.items()) + sum(m * q for m, q in zip(mv, b, strict=True))
            g.append((1 / (1 + math.exp(-max(-30, min(30, s)))) - bad) * (0.5 / positive if bad else 0.5 / (n - positive)))
        gw = {i: toxicity.RIDGE / n * mw[i] for i in mw}
        for a, q in zip(x, g, strict=True):
            for i, u in a.items():
                gw[i] += u * q
        gv = [sum(b[j] * q for b, q in zip(z, g, strict=True)) for j in range(len(v))]
        nw, nv = {i: mw[i] - step * gw[i] for i in mw}, [m - step * q for m, q in zip(mv, gv, strict=True)]
        mw, mv = {i: nw[i] + k / (k + 3) * (nw[i] - w[i]) for i in nw}, [a + k / (k + 3) * (a - b) for a, b in zip(nv, v, strict=True)]
        w, v, top = nw, nv, max(map(abs, gw.values()))
        if last is not None and k % 20 == 0 and abs(top - last) < 1e-7:
            break
        last = top
    return lambda words, e: sum(w[i] * ratio[i] / scale for i in words if i in w) + v[-1] + sum(a / 4 * b for a, b in zip(v, e, strict=False))


def test_chain_is_brute_force(spark):
    rng, rows, labels = random.Random(12), [], []
    for i in range(90):
        bad, poor = rng.random() < 0.4, rng.random() < 0.4
        rows.append((i, " ".join(rng.choices(LEXICON[:60], k=rng.randint(5, 30)) + (["scum"] * bad) + (["click"] * poor) + ([] if rng.random() < 0.5 else ["noise"]))))
        labels.append((i, int(poor), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    conditions = {"poor": F.col("poor") == 1, "bad": F.col("bad") == 1}
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, poor int, bad int"), conditions)
    found = by_id(toxicity.classify(docs, chain))
    held = {k: sorted(set(ALNUM.findall(low(t)))) for k, t in rows}
    vocabulary, earlier, oof, models = sorted({w for x in held.values() for w in x}), [[] for _ in rows], [[] for _ in rows], []
    clip = lambda s: max(-8.0, min(8.0, s))
    for c in (1, 2):
        y = [x[c] for x in labels]
        models.append(plain_fit([held[k] for k, _ in rows], oof, y, vocabulary))
        fresh = {}
        for fold in range(toxicity.FOLDS):
            train = [i for i in range(len(rows)) if i % toxicity.FOLDS != fold]
            model = plain_fit([held[i] for i in train], [oof[i] for i in train], [y[i] for i in train], vocabulary)
            fresh |= {i: clip(model(held[i], oof[i])) for i in range(len(rows)) if i % toxicity.FOLDS == fold}
        oof = [[*e, fresh[i]] for i, e in enumerate(oof)]
    for i, _ in rows:
        for model in models:
            earlier[i].append(clip(model(held[i], earlier[i])))
        want = [1 / (1 + math.exp(-s)) for s in earlier[i]]
        assert (found[i].p_poor, found[i].p_bad) == (pytest.approx(want[0], abs=1e-6), pytest.approx(want[1], abs=1e-6))


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_licenses_are_brute_force(spark):
    """Every template against every text, whole: what is reported has COVERAGE of its words in order, and a notice that was put in and still has is reported."""
    rng, rows = random.Random(14), []
    for i, (name, template) in enumerate(sorted(licenses.TEMPLATES.items())):
        words = template.split()
        for j in range(6):
            held = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 6)) if j else 0):
                held[rng.randrange(len(held))] = rng.choice(LEXICON)
            if j >= 3 and len(words) >= 20:  # a short notice is not looked for in pieces
                at = rng.randrange(len(held))
                held[at:at] = rng.choices(LEXICON, k=rng.randint(1, 30))
            rows.append((10 * i + j, " ".join([*prose(rng.randint(0, 30), 10 * i + j).split(), *held, *prose(rng.randint(0, 30), 5000 + i).split()])))
    found = by_id(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    cut, names = {n: ALNUM.findall(low(t)) for n, t in licenses.TEMPLATES.items()}, sorted(licenses.TEMPLATES)
    for k, t in rows:
        words = ALNUM.findall(low(t))
        want = {n for n, w in cut.items() if common(w, words) >= licenses.COVERAGE * len(w)}
        # A short notice may lie scattered in another's words; it is looked for where it was put.
        assert {names[k // 10]} & want <= {x.license for x in found[k].licenses} <= want, k
        for x in found[k].licenses:
            assert x.coverage * len(cut[x.license]) <= common(cut[x.license], words[x.start : x.stop]) + 1e-9 and t.encode()[x.from_byte : x.to_byte].split() is not None


def plain_quality(text):
    """The whole verdict of the quality rules."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    chars = sum(map(len, w))
    inside = {}
    for n in {8, *quality.NGRAM_LIMITS}:
        seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        inside[n] = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        size = sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
        dup += size if size and line in lines else 0
        lines.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", t))
    good = len(w) >= 20 and 100 * len(inside[8]) <= 30 * len(w) and 100 * dup <= quality.LINE_LIMIT * chars and 100 * symbols <= quality.SYMBOL_LIMIT * chars
    return good and all(100 * sum(len(w[i]) for i in inside[n]) <= limit * chars for n, limit in quality.NGRAM_LIMITS.items())


def plain_mix(rows):
    """How often each (doc_id, text, source) is taken: budgets by repeated sharing, a source's end by trying all its places."""
    sources = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    size = lambda t: len(SPACE.findall((t or "").encode()))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, held, open_ = 1.5 * sum(total.values()), {}, set(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * total[s]}
        held |= {s: 2.0 * total[s] for s in full} if full else share
        left -= sum(2 * total[s] for s in full)
        open_ = open_ - full if full else set()
    taken = {}
    for s in sources:
        mine = [(int(hashlib.md5((str(k) if k is not None else t or "").encode()).hexdigest()[:15], 16) >> 24, k, t) for k, t, x in rows if x == s]
        times, ends = int(held[s] // total[s]) if total[s] else 0, sorted({h for h, *_ in mine})
        rest, upto, below = held[s] - times * total[s], 0, 0
        for h in ends:
            n = sum(size(t) for p, _, t in mine if p == h)
            if upto + n > rest:
                below = h + (1 if 2 * (rest - upto) > n else 0)
                break
            upto += n
        taken |= {(k, t): min(2, times + (h < below)) for h, k, t in mine}
    return taken


def test_a_worker_reads_the_tokenizer_once_and_learns_runs_of_signs_once():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    one, two = token_files.Encoder(path), token_files.Encoder(path)
    assert one.tokenizer is two.tokenizer
    whole, signs = Tokenizer.from_file(path), "ab z.,'-<|>$#*%&019\x1c\x7f\x00éßİſ日\u0301\u3000 tsredvml\n"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(2000)] + ["words, it's. a.b 12ab== überall. 日a."]
    assert [x.tolist() for x in one.encode([t.encode() for t in texts])] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert one.young[b"12ab=="] == b"".join(one.young[p] for p in (b"1", b"2", b"ab", b"=="))


def test_pipeline_is_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    passage, items = prose(120, 2), [(1, prose(20, 4)), (2, "")]
    base = {k: prose(90 + k, 600 + k) for k in range(40)}
    edit = lambda t, k: " ".join(f"new{k}" if i == 40 else w for i, w in enumerate(t.split()))
    rows = [(k, t) for k, t in base.items()] + [(100 + k, edit(base[k], k)) for k in range(0, 40, 3)] + [(7, base[8]), (200, base[9]), (200, prose(100, 9999)), (201, None), (202, "too short"), (203, "same line\n" * 40), (204, f"{prose(50, 4)} {passage}"), (205, BIG[:1_100_000])]
    rows = [(k, t, "en", ["a", "b", None, "c"][i % 4], 0) for i, (k, t) in enumerate(rows)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(k, t, s) for k, t, _, s, _ in rows if plain_quality(t)]
    shingles = {t: {tuple(w[i : i + 5]) for w in [SPACE.findall(low(t))] for i in range(len(w) - 4)} for _, t, _ in left}
    groups = []
    for row in left:
        near = [g for g in groups if any(5 * len(shingles[x[1]] & shingles[row[1]]) >= 4 * len(shingles[x[1]] | shingles[row[1]]) for x in g)]
        groups = [g for g in groups if g not in near] + [[row, *(x for g in near for x in g)]]
    order = lambda x: (x[0] is None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).digest()[:16])
    left = [min(g, key=order) for g in groups]
    left = [r for r in left if not hits(r[1], [(i, t) for i, t in items if len(t) > 0], 10)[1]]
    times = plain_mix(left)
    found = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    whole, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, Counter()
    for (k, t), n in times.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want[k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == +want and len(found) > 30
    for r in found:
        assert r.start == start
        start += r.n_tokens


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
