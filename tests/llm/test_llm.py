"""The operators of the subpackage: against SQL or brute force, and on nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import _shared, archives, decontaminate, licenses, lm_score, mixture, near_copies, quality, registry, simhash, suffix_dedup, token_files, toxicity
from graphloom.llm._text import U64, hash_ranges

FOLDER = Path("/root/testdata/sf0.001")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
UP = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACE, ALNUM = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = random.Random(7)
LEXICON = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 8))) for _ in range(400)] + ["été", "über", "日本"]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(LEXICON, k=n))


LONG = prose(60_000, 1)
PASSAGE = prose(120, 2)
TEXTS = {
    1: prose(200, 3), 2: prose(200, 3), 3: prose(200, 3) + " tail", 4: None, 5: "", 6: "   \n\t ", 7: "one", 8: "Two words", 9: LONG, 10: LONG,
    11: prose(50, 4) + " " + PASSAGE + " " + prose(60, 5), 12: PASSAGE, 13: prose(30, 6) + "\n" + PASSAGE, 14: "a" * 5000, 15: "spam line here\n" * 40, 16: "#$% ***" * 60,
    17: "É" * 900, 18: (prose(12, 8) + " ") * 9, 19: "x " * 500, 20: prose(300, 9).upper(), 21: "Released under the MIT License.", 22: prose(40, 10) + " licensed under the Apache license, version 2.0. " + prose(40, 11),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, v, "en", ["a", "b", None, "c"][k % 4], 0) for k, v in TEXTS.items()]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def odd(docs):
    """Repeated rows, rows without an id, and columns whose names operators use themselves."""
    names = ("h", "size", "target", "copies", "below", "turn", "_spans", "fp", "component_id", "kept", "copy", "key", "spans", "block", "toxic", "_id")
    more = docs.union(docs.where("doc_id IN (1, 4, 11)")).union(docs.where("doc_id IN (2, 12)").withColumn("doc_id", F.lit(None).cast("long")))
    return more.select("*", *(F.lit("x").alias(n) for n in names))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def low(text):
    return (text or "").encode().translate(UP)


@pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_has_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found, want = registry.QUERIES[name](spark, str(FOLDER)), con.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(found.columns) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    assert Counter(tuple(plain(r[c]) for c in columns) for r in found.collect()) == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


OPERATORS = {
    "quality": lambda d: quality.quality_rules(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "near_copies": lambda d: near_copies.near_copies(d),
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, PASSAGE)], "item_id long, text string")),
    "mixture": lambda d: mixture.mixture(d),
    "tokens": lambda d: token_files.token_files(d),
    "suffix": lambda d: suffix_dedup.remove_repeats(d),
    "licenses": lambda d: licenses.scan_licenses(d),
    "lm": lambda d: lm_score.score_documents(d, d.sparkSession.createDataFrame([(1, 1), (1, 0), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")),
    "toxicity": lambda d: toxicity.classify(d, toxicity.train(d, d.sparkSession.createDataFrame([(1, 1), (9, 0), (11, 0), (12, None)], "doc_id long, toxic int"), {"toxic": F.col("toxic") == 1})),
    "keep_good": lambda d: quality.keep_good(d),
    "keep_one": lambda d: simhash.keep_one(d),
    "keep_clean": lambda d: decontaminate.keep_clean(d, d.sparkSession.createDataFrame([(1, PASSAGE)], "item_id long, text string")),
    "mix_rows": lambda d: mixture.mix_rows(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(none, name):
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_null_ids_and_other_columns(odd, name):
    found = OPERATORS[name](odd)
    if name.startswith(("keep", "mix_rows")):
        assert found.columns == odd.columns and found.count() > 0
    else:
        assert found.count() == odd.count()


def test_quality_verdicts(docs):
    found = by_id(quality.quality_rules(docs))
    assert {k for k, r in found.items() if r.kept} >= {1, 2, 3, 9, 11, 12, 13, 20, 22}
    assert not any(found[k].kept for k in (4, 5, 6, 7, 8, 14, 15, 16, 18, 19))
    for k, t in TEXTS.items():
        w = SPACE.findall((t or "").encode())
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").encode().split(b"\n") if SPACE.search(x)]
        assert (found[k].n_words, found[k].n_repeat_words, found[k].n_dup_lines) == (len(w), len(hit), len(lines) - len(set(lines))), k


def fingerprint(text):
    w = SPACE.findall(low(text))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints):
    ids, root = sorted(prints), {}
    for k in ids:
        if k not in root:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = k
                    todo += [y for y in ids if y not in root and (prints[x] ^ prints[y]).bit_count() <= 2]
    return root


def test_fingerprints_and_groups(docs):
    prints = {k: fingerprint(t) for k, t in TEXTS.items()}
    found = by_id(simhash.near_duplicates(docs))
    assert {k: r.fp % 2**64 for k, r in found.items()} == prints
    assert {k: r.component_id for k, r in found.items()} == roots(prints)


def test_xxh64_of_all_lengths():
    data = np.frombuffer(random.Random(1).randbytes(40_000), np.uint8)
    size = np.array([n for n in range(300) for _ in range(5)])
    starts = np.arange(len(size)) * 20
    found = simhash.xxh64_ranges(data, starts, starts + size)
    assert [int(x) for x in found] == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, size, strict=True)]


@pytest.mark.parametrize("bucket", [1000, 4])
def test_links_of_crowded_blocks_are_whole(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    prints = {i: rng.getrandbits(64) for i in range(40)}
    for i in range(40, 160):
        prints[i] = prints[rng.randrange(i)] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    signed = {k: v - (v >> 63 << 64) for k, v in prints.items()}
    found = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in set(signed.values())], "fp long")))
    root = {r.node: r.root for r in found.collect()}
    groups = {}
    for k, r in roots(prints).items():
        groups.setdefault(r, set()).add(signed[k])
    for members in groups.values():
        assert {root.get(v, v) for v in members} == {min(members)}


def test_one_document_of_each_group_stays(odd):
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert sorted(x for x in kept if x) == sorted({r.component_id for r in simhash.near_duplicates(odd).collect() if r.component_id})


def shingles(text):
    w = SPACE.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def edited(text, n, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("bucket", [1000, 8, 2])
def test_near_copies_are_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    monkeypatch.setattr(near_copies, "SMALL_SETS", 0 if bucket == 8 else 1 << 25)
    monkeypatch.setattr(_shared, "TASK_ROWS", 3 if bucket == 8 else 100_000)  # rounds of components with shuffles and without
    monkeypatch.setattr(near_copies, "TASK_PAIRS", 7 if bucket == 8 else 5000)
    rng, texts = random.Random(9), {k: t for k, t in TEXTS.items() if k not in (9, 10)}
    for i in range(12):
        base = prose(150 + 10 * i, 700 + i)
        texts[100 + 20 * i] = base
        # Copies near a base, copies of copies, and some that are about as near as they may be, or just not.
        for j in range(1, 20):
            texts[100 + 20 * i + j] = edited(texts[100 + 20 * i + rng.randrange(j)] if j % 2 else base, rng.randint(1, 5), rng)
    sets, ids = {k: shingles(t) for k, t in texts.items()}, sorted(texts)
    near = {k: [x for x in ids if (sets[k] == sets[x] or sets[k] and sets[x] and 5 * len(sets[k] & sets[x]) >= 4 * len(sets[k] | sets[x]))] for k in ids}
    root = {}
    for k in ids:
        todo = [k] if k not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = k
                todo += near[x]
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, fp string")
    assert {k: r.component_id for k, r in by_id(near_copies.near_copies(docs)).items()} == root
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root.values()))


def test_a_group_costs_a_few_pairs_a_class(spark, monkeypatch):
    """Copies of one text that are just not similar to one another, and near copies of its middle: neither is compared pair by pair."""
    rng, made, plain = random.Random(7), [], near_copies.verified
    apart, middle = prose(150, 71), prose(150, 72)
    rows = [(k, edited(apart, 3, rng)) for k in range(1, 101)] + [(101, middle)] + [(k, edited(middle, 1 + k % 2, rng)) for k in range(102, 161)]
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: made.append(pairs.count()) or plain(pairs, sets))
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: shingles(t) for k, t in rows}
    near = {k: [x for x in sets if 5 * len(sets[k] & sets[x]) >= 4 * len(sets[k] | sets[x])] for k in sets}
    assert all(found[k] == found[x] for k in near for x in near[k])
    assert [found[k] for k in near if near[k] == [k]] == [k for k in near if near[k] == [k]]
    assert [found[k] for k in range(101, 161)] == [101] * 60
    assert 60 <= sum(made) <= 8 * len(rows)


def test_near_copies_go_through_simhash_and_bands(spark, monkeypatch):
    """Each way alone finds what it can find: fingerprints within two bits, equal ones of different sets included; bands the rest."""
    rng, base = random.Random(4), prose(3000, 31)
    rows = [(1, base), (2, edited(base, 1, rng)), (3, edited(base, 1, rng)), (4, prose(200, 32)), (5, edited(prose(200, 32), 3, rng)), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: r.sim % 2**64 for r in near_copies.prints_and_bands(docs).collect()}
    assert max((prints[1] ^ prints[k]).bit_count() for k in (2, 3)) <= 2 < (prints[4] ^ prints[5]).bit_count()  # so the input is what it should be
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept() == [1, 4, 6]
    monkeypatch.setattr(near_copies, "_pairs", lambda members, keys: members.limit(0).select(*(F.lit(0).cast("long").alias(x) for x in ("u", "v", "nu", "nv"))))
    assert kept() == [1, 4, 5, 6]


def hits(text, items, window):
    w, hit, found = ALNUM.findall(low(text)), set(), set()
    for name, item in items:
        v = ALNUM.findall(low(item))
        for a in range(max(1, len(v) - window + 1) if v else 0):
            g = v[a : a + window]
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(name)
    return len(w), len(hit), len(found)


@pytest.mark.parametrize("most", [500_000, 20])
def test_decontamination_is_brute_force(spark, docs, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "INDEX_SHINGLES", most)
    items = [(1, PASSAGE), (2, prose(14, 4)), (3, "two WORDS"), (4, None), (5, ""), (6, "one"), (7, PASSAGE), (8, prose(300, 3)[:200])]
    found = by_id(decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")))
    for k, t in TEXTS.items():
        assert (found[k].n_words, found[k].n_hit, found[k].n_items) == hits(t, items, 10), k


def test_partial_containment(spark):
    words = prose(10, 20).split()
    changed = " ".join(["zz", *words[:4], "CHANGED", *words[5:], "zz"])
    docs = spark.createDataFrame([(1, changed), (2, prose(60, 21))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [decontaminate.decontaminate(docs, items, containment=c).where("contaminated").count() for c in (0.6, 0.7, 1.0)] == [1, 0, 0]


def test_mix_is_near_its_targets(spark):
    rows = [(i, prose(i % 50, i), "en", f"s{i % 5 if i % 3 else 0}", 0) for i in range(3000)]
    found = mixture.mixture(spark.createDataFrame(rows, DOC))
    for r in found.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 50 and r.target <= 2 * r.source_size
    assert found.where("taken > 2 * size").count() == 0
    assert abs(found.agg(F.sum("taken")).first()[0] - 1.5 * found.agg(F.sum("size")).first()[0]) < 300
    assert sorted(found.collect()) == sorted(mixture.mixture(spark.createDataFrame(rows[::-1], DOC)).collect())


def test_token_files_hold_the_librarys_ids(docs):
    from tokenizers import Tokenizer

    whole, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    found = by_id(token_files.token_files(docs))
    for k, t in sorted(TEXTS.items()):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert tuple(found[k])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), k
        start += len(ids)


@pytest.mark.parametrize("text", ["it's. A.B, c.. ,x ...", "a.́ é. É, ǆ ŉ İstanbul", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "don't, we'll.", "x y z\x1cw", "ﬁ ½ ２３ a1b2. 1.5, 日本。", "tab\tnew\nline.\r\nend,"])
def test_encoder_is_the_library(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode([text.encode(), b"Plain words, here.", text.encode()])
    assert [x.tolist() for x in found] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in (text, "Plain words, here.", text)]


def test_elias_fano_selects():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (7, 1), (1000, 3), (5000, 10**7), (800, 10**13)):
        values = np.sort(rng.integers(0, top, n))
        found, rest = token_files.EliasFano.load(memoryview(token_files.EliasFano.of(values).dump() + b"rest"))
        assert found.all().tolist() == values.tolist() == [found.select(i) for i in range(n)] and bytes(rest) == b"rest"
        assert n < 1000 or len(found.low) + len(found.high) < 8 * n


def test_a_shard_finds_documents():
    documents = [np.array(x, np.uint32) for x in ([1], [70_000, 1], [5, 6, 1])]
    shard = token_files.Shard(token_files.Shard.dump([None, -4, 9], documents))
    assert [shard.document(i).tolist() for i in range(3)] == [x.tolist() for x in documents] and shard.doc_ids() == [None, -4, 9]


def without_repeats(texts, n):
    count = Counter(t[i : i + n] for t in texts.values() for i in range(len(t) - n + 1))
    out = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[k] = (len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("few", "batches"), [(64, 3), (1, 5)])
def test_long_repeats_go(spark, few, batches):
    texts = {k: (t or "").encode() for k, t in TEXTS.items() if k not in (9, 10)} | {30 + i: f"{prose(i, i)} {PASSAGE[: 300 + 9 * i]} {prose(3, 50 + i)}".encode() for i in range(40)}
    found = suffix_dedup.remove_repeats(spark.createDataFrame([(k, t.decode()) for k, t in texts.items()], "doc_id long, text string"), n_batches=batches, few=few)
    assert {r.doc_id: tuple(r)[1:5] for r in found.collect()} == without_repeats(texts, 400)


def test_long_documents_are_cut_into_segments(spark):
    rng = random.Random(5)
    part = "".join(rng.choices("abcdefghij ", k=3000))
    one, two = ("".join(rng.choices(x, k=1_300_000)) for x in ("klmnopq", "rstuvwx"))
    at = (1 << 20) - 700
    rows = [(1, one[:at] + part + one[at:]), (2, two[:100] + part + two[100:1000])]
    found = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(s.start, s.stop) for s in found[1].spans] == [(at, at + 3000)] and [(s.start, s.stop) for s in found[2].spans] == [(100, 3100)]


def classes(text):
    out = []
    for w in ALNUM.findall(low(text)):
        b = np.frombuffer(w, np.uint8)
        out.append(int(hash_ranges(b, np.array([0]), np.array([len(b)]))[0] >> U64(64 - lm_score.BITS)))
    return out


@pytest.mark.parametrize("share", [1 / 1024, 0.9])
def test_losses_are_brute_force(spark, docs, monkeypatch, share):
    monkeypatch.setattr(lm_score, "HOT_SHARE", share)
    few = docs.where("doc_id NOT IN (9, 10)")
    good = {1, 11, 20}
    found = by_id(lm_score.score_documents(few, spark.createDataFrame([(k, 1) for k in good] + [(2, 0)], "doc_id long, quality int")))
    held = {k: classes(TEXTS[k]) for k in found}
    pairs, contexts = ({g: Counter() for g in (True, False)} for _ in range(2))
    for k, t in held.items():
        before = [lm_score.START, *t[:-1]] if t else []
        pairs[k in good].update(zip(before, t, strict=True))
        contexts[k in good].update(before)
    scale = {True: 1.0, False: contexts[True].total() / contexts[False].total()}
    for k, t in held.items():
        before = [lm_score.START, *t[:-1]] if t else []
        own, mine = Counter(zip(before, t, strict=True)), Counter(before)
        for g, loss in ((True, found[k].target_loss), (False, found[k].background_loss)):
            left = 1 if g == (k in good) else 0
            want = sum(math.log(scale[g] * (contexts[g][h] - left * mine[h]) + lm_score.MASS) - math.log(scale[g] * (pairs[g][h, w] - left * own[h, w]) + lm_score.MASS / lm_score.CLASSES) for h, w in zip(before, t, strict=True))
            assert loss is None if not t else abs(loss - want / len(t)) < 1e-4


def test_chain_learns_and_leaves_clean_documents_alone(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        bad, poor = rng.random() < 0.2, rng.random() < 0.3
        words = rng.choices(LEXICON, k=rng.randint(20, 150)) + (rng.choices(["idiot", "scum", "trash"], k=rng.randint(1, 4)) if bad else []) + (["click", "buy"] if poor else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    found = by_id(toxicity.classify(docs, chain))
    held = [(found[i].toxic, bool(t)) for i, _, t in labels[600:]]
    assert sum(a and b for a, b in held) >= 0.95 * sum(b for _, b in held) and sum(a and not b for a, b in held) <= 0.03 * len(held)


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 2000)
    page = lambda i: f"<html>{prose(40, i)}</html>"
    rows = [(i, f"http://x/{i} y", page(i % 25)) for i in range(60)] + [(100, None, None), (101, "", ""), (102, "http://z", "short"), (103, "http://z", "short"), (None, "http://n", page(3)), (5, "http://x/5", page(5))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    arcs = archives.write_arcs(pages, f"{tmp_path}/arc")
    warcs = archives.convert(arcs, f"{tmp_path}/arc", f"{tmp_path}/warc")
    found = archives.read_warcs(warcs, f"{tmp_path}/warc").collect()
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in found) == Counter((i, len((h or "").encode()), digest(h)) for i, _, h in rows)
    page_of = {r.record_id: r.page_id for r in found}
    for r in found:
        same = [i for i, _, h in rows if digest(h) == r.payload_digest and i is not None]
        if r.record_type == "revisit":
            assert page_of[r.refers] == min(same)
    assert Counter(r.record_type for r in found) == {"response": 25 + 4, "revisit": 66 - 29}
    assert {r.date for r in found} == {"2024-01-01T00:00:00Z"}


@pytest.mark.parametrize("pack", [bytes, lambda b: gzip.compress(b)])
def test_arc_versions(pack):
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    one = b"filedesc://a.arc 0.0.0.0 19990101 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n" + b" " * 17 + b"\n"
    one = one[: one.index(b"\n") + 1] + one[one.index(b"\n") + 1 :][:76] + b"\n" + f"http://a 1.2.3.4 199902 text/html {len(body)}\n".encode() + body + b"\n"
    head = (f"2 0 Org\n{archives.FIELDS[2]}\n").encode()
    two = f"filedesc://b.arc 0.0.0.0 19990101 text/plain 200 - - 0 - {len(head)}\n".encode() + head + b"\n" + f"http://b 1.2.3.4 19990203040506 text/html 200 x - 7 b.arc {len(body)}\n".encode() + body + b"\n"
    for data, url, date in ((one, "http://a", "1999-02-01T00:00:00Z"), (two, "http://b", "1999-02-03T04:05:06Z")):
        (r,) = archives.arc_records(io.BufferedReader(archives.Members(io.BytesIO(pack(data)))))
        assert (r["URL"], archives.iso_time(r["Archive-date"]), r["block"]) == (url, date, body)
    with pytest.raises(ValueError, match="before the declared length"):
        list(archives.arc_records(io.BufferedReader(archives.Members(io.BytesIO(pack(two[:-8]))))))


def test_licenses_and_their_spans(spark, docs):
    found = {k: [(x.license, x.coverage) for x in r.licenses] for k, r in by_id(licenses.scan_licenses(docs)).items() if r.licenses}
    assert found == {21: [("MIT", 1.0)], 22: [("Apache-2.0", 1.0)]}
    text = licenses.TEMPLATES["MIT-text"].split()
    near = " ".join([*prose(30, 1).split(), *text[:20], "inserted", *text[20:30], *text[31:], *prose(9, 2).split()])
    rows = spark.createDataFrame([(1, near), (2, "x All rights reserved y"), (3, " ".join(text[:9]))], "doc_id long, text string")
    got = by_id(licenses.scan_licenses(rows))
    (hit,) = got[1].licenses
    assert hit.license == "MIT-text" and hit.coverage > 0.95 and hit.start == 30
    assert [x.license for x in got[2].licenses] == ["All-rights-reserved"] and not got[3].licenses


def test_licenses_in_pieces_and_short_ones_with_a_changed_word():
    text = licenses.TEMPLATES["MIT-text"].split()
    half = len(text) // 2
    apart = [*text[:half], *prose(20, 3).split(), *text[half:]]
    texts = [" ".join([*prose(30, 1).split(), *apart, *prose(40, 2).split()]), "x Released under an MIT License y", " ".join([*apart, *prose(9, 4).split(), *apart]), " ".join(text[:half]), "Released under an old license"]
    rows = licenses.Block(licenses.pa.RecordBatch.from_pylist([]), [t.encode() for t in texts])
    found = [[(x["license"], x["coverage"], x["start"], x["stop"]) for x in r] for r in licenses.Index(licenses.TEMPLATES).scan(rows)]
    n = len(ALNUM.findall(" ".join(apart).encode()))
    assert found == [[("MIT-text", 1.0, 30, 30 + n)], [("MIT", 0.8, 1, 6)], [("MIT-text", 1.0, 0, n), ("MIT-text", 1.0, n + 9, 2 * n + 9)], [], []]
