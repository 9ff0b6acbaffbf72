"""Benchmark decontamination by a prefix-filtered set join.

The items' windows (of ``WINDOW`` words; an item of fewer words is one window) are sets of word shingles. A pass over
all documents counts how often each of those shingles occurs, and the shingles of a window are ordered by that rarity.
A document that contains a share ``containment`` of a window's shingles must contain one of the first
L - ceil(containment * L) + 1 of them, so only those prefix shingles are looked up in a second pass (one shingle for
exact containment). A match at place p of a shingle with offset o places the window at p - o; the window has to lie in
the document (length and positional bounds), and is then verified there: word by word for exact containment, else by
the share of equal shingles.

The item index is sent to all tasks only in blocks of at most ``INDEX_SHINGLES`` shingles, which is checked; a larger
benchmark is joined block by block, each in a pass of its own over the documents, with the same result. There is no shuffle
of documents, so hot passages only mean more hits where they are read.

Null texts have no words; null items and items without words match nothing; an item id may repeat (its windows count
together). Repeated documents are judged one by one. Empty tables give no hits or no rows. Other columns are not read by
``decontaminate`` and are passed on by ``keep_clean``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._shared import content_digest, cut, drop, fresh, written
from graphloom.llm._text import ALNUM, LOWER, U64, Block, blocks, covered, hash_ranges, mix, sums_by_text

WINDOW = 10
SHINGLE = 3
INDEX_SHINGLES = 500_000
#: So many spans are sent to all tasks at most; more are joined. Only where the index has several blocks.
FEW_SPANS = 1_000_000
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
WINDOWS = "part int, item_id string, words array<binary>, shingles array<long>"


def _roll(words: np.ndarray, n: int) -> np.ndarray:
    value = np.zeros(max(len(words) - n + 1, 0), U64)
    for i in range(n if len(value) else 0):
        value = value * U64(0xD6E8FEB86659FD93) + words[i : i + len(value)]
    return mix(value + U64(n))


class Words:
    """Lower-cased words of a block, with the hashes of their shingles of the lengths that an index uses."""

    def __init__(self, block: Block):
        self.buf = LOWER[block.buf]
        self.starts, self.ends, self.first = block.words(ALNUM)
        self.hashes = hash_ranges(self.buf, self.starts, self.ends)
        self.text = np.repeat(np.arange(len(block)), np.diff(self.first))

    def shingles(self, n: int) -> np.ndarray:
        return _roll(self.hashes, n)

    def bytes(self, a: int, b: int) -> list[bytes]:
        return [self.buf[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True)]


def item_windows(items: DataFrame, item_id: str, text: str, window: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words, rows = Words(block), []
            for i, name in enumerate(block.rows.column(1).to_pylist()):
                a, b = words.first[i : i + 2]
                for at in range(a, max(a, b - window) + 1 if b > a else a):
                    n = min(window, b - at)
                    held = words.hashes[at : at + n]
                    rows.append((block.rows.column(0)[i].as_py(), name, words.bytes(at, at + n), _roll(held, min(SHINGLE, n)).view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((),) * 4, (pa.int32(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64())), strict=True)], ["part", "item_id", "words", "shingles"])

    part = F.pmod(F.xxhash64(items[item_id].cast("string")), F.lit(parts)).cast("int")
    return items.where(items[text].isNotNull() & items[item_id].isNotNull()).select(part.alias("part"), items[item_id].cast("string").alias("item_id"), items[text].alias("text")).mapInArrow(run, WINDOWS)


def count_shingles(docs: DataFrame, wanted: dict[int, np.ndarray], text: str) -> dict[int, np.ndarray]:
    """How often each of the wanted shingle hashes (ascending, by length in words) occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: np.zeros(len(keys), np.int64) for n, keys in sent.value.items()}
        for block in blocks(batches, "text"):
            words = Words(block)
            for n, keys in sent.value.items():
                grams = words.shingles(n)
                grams = grams[words.text[: len(grams)] == words.text[n - 1 :]] if len(grams) else grams
                at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                found[n] += np.bincount(at[keys[at] == grams], minlength=len(keys))
        for n, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int64)), pa.array(counts[at])], ["n", "at", "c"])

    out = {n: np.zeros(len(keys), np.int64) for n, keys in wanted.items()}
    for n, at, c in docs.select(docs[text].alias("text")).mapInArrow(run, "n int, at long, c long").groupBy("n", "at").agg(F.sum("c")).toLocalIterator():  # at most INDEX_SHINGLES rows
        out[n][at] = c
    return out


class Index:
    """Prefix shingles of the windows that can occur, by shingle length: sorted keys and their postings."""

    def __init__(self, windows: list[tuple], wanted: dict[int, np.ndarray], counts: dict[int, np.ndarray], containment: float):
        self.containment, self.windows, self.items = containment, [], []
        known, postings = {}, {n: [] for n in wanted}
        for item, words, shingles in windows:
            words = tuple(bytes(w) for w in words)
            if words in known:
                self.items[known[words]].add(item)
                continue
            n = min(SHINGLE, len(words))
            keys = np.array(shingles, np.int64).view(U64)
            often = counts[n][np.searchsorted(wanted[n], keys)]
            need = math.ceil(containment * len(keys) - 1e-9)
            prefix = np.lexsort((keys, often))[: len(keys) - need + 1]
            prefix = prefix[often[prefix] > 0]
            known[words] = len(self.items)
            self.items.append({item})
            self.windows.append((words, keys))
            postings[n] += [(keys[o], len(self.items) - 1, o) for o in prefix]
        self.postings = {}
        for n, rows in postings.items():
            if rows:
                keys, which, offset = (np.array(x, t) for x, t in zip(zip(*rows, strict=True), (U64, np.int64, np.int64), strict=True))
                order = np.argsort(keys, kind="stable")
                self.postings[n] = keys[order], which[order], offset[order]
        self.sizes = np.array([len(w) for w, _ in self.windows], np.int64)

    def matches(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """Text, first word, number of words and window of each verified match in a block."""
        for n, (keys, which, offset) in self.postings.items():
            grams = words.shingles(n)
            lo = np.searchsorted(keys, grams)
            at = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == grams)
            count = np.searchsorted(keys, grams[at], "right") - lo[at]
            entry = np.repeat(lo[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place = np.repeat(at, count)
            start, size, window = place - offset[entry], self.sizes[which[entry]], which[entry]
            text = words.text[place]
            fits = (start >= words.first[text]) & (start + size <= words.first[text + 1])
            for t, s, m, w in set(zip(text[fits].tolist(), start[fits].tolist(), size[fits].tolist(), window[fits].tolist(), strict=True)):
                held, keys_of = self.windows[w]
                if self.containment >= 1:
                    good = all(words.buf[a:b].tobytes() == x for a, b, x in zip(words.starts[s : s + m], words.ends[s : s + m], held, strict=True))
                else:
                    good = np.mean(grams[s : s + len(keys_of)] == keys_of) >= self.containment - 1e-9
                if good:
                    yield t, s, m, w


def build_indexes(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, containment: float) -> Iterator[Index]:
    """Indexes of blocks of the items, each of at most INDEX_SHINGLES shingles (or of one item with more)."""
    spark = docs.sparkSession
    n = item_windows(items, item_id, item_text, window, 1).agg(F.sum(F.size("shingles"))).first()[0] or 0
    parts = max(1, math.ceil(2 * n / INDEX_SHINGLES)) if n > INDEX_SHINGLES else 1
    table, folder = written(item_windows(items, item_id, item_text, window, parts), "windows")
    for part in range(parts):
        rows = [(r.item_id, r.words, r.shingles) for r in table.where(F.col("part") == part).toLocalIterator()]
        wanted = {k: np.unique(np.concatenate([np.array(s, np.int64).view(U64) for _, w, s in rows if min(SHINGLE, len(w)) == k])) for k in {min(SHINGLE, len(w)) for _, w, _ in rows}}
        yield Index(rows, wanted, count_shingles(docs, wanted, text) if wanted else {}, containment)
    drop(spark, folder)


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("item", pa.string())]))


def _spans(docs: DataFrame, index: Index, text: str, into: str) -> DataFrame:
    """docs with a column of spans (first word, words, item)."""
    sent, columns = docs.sparkSession.sparkContext.broadcast(index), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            words, rows = Words(block), [[] for _ in block.texts]
            for t, s, m, w in sent.value.matches(words):
                rows[t] += [{"start": s - int(words.first[t]), "size": m, "item": item} for item in sorted(sent.value.items[w])]
            yield pa.RecordBatch.from_arrays([*block.rows.columns, pa.array(rows, SPAN)], [*columns, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{into}` array<struct<start: long, size: long, item: string>>")


def matched(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, containment: float = 1.0, into: str = "_spans") -> DataFrame:
    """docs with a column of each occurrence of a window, as first word, number of words and item.

    With several blocks of the index, what each finds is kept by the digest of the text, and joined with the documents once."""
    indexes = build_indexes(docs.select(text), items, text, item_id, item_text, window, containment)
    index, later = next(indexes), next(indexes, None)
    if later is None:
        return _spans(docs, index, text, into)
    keyed, found = docs.select(docs[text].alias("text"), content_digest(docs[text]).alias("of")), []
    while index is not None:
        one = _spans(keyed, index, "text", "spans").where("size(spans) > 0").select("of", "spans")
        found.append(cut(one.groupBy("of").agg(F.first("spans").alias("spans"))))
        index, later = later, next(indexes, None)
    hits = found[0]
    for x in found[1:]:
        hits = hits.union(x)
    d = fresh("of", docs.columns)
    hits = cut(hits.groupBy(F.col("of").alias(d)).agg(F.flatten(F.collect_list("spans")).alias(into)))
    if (hits.agg(F.sum(F.size(into))).first()[0] or 0) <= FEW_SPANS:
        hits = F.broadcast(hits)
    return docs.withColumn(d, content_digest(docs[text])).join(hits, d, "left").drop(d).withColumn(into, F.coalesce(into, F.array().cast("array<struct<start: long, size: long, item: string>>")))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, containment: float = 1.0) -> DataFrame:
    """One row a document: words, words inside occurrences of item windows, and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(block)
            spans = [[(s["start"], s["size"], s["item"]) for s in x or ()] for x in block.rows.column(block.rows.schema.get_field_index("_spans")).to_pylist()]
            at = [(int(words.first[t]) + a, n) for t, x in enumerate(spans) for a, n, _ in x]
            starts, sizes = (np.array([x[i] for x in at], np.int64) for i in (0, 1))
            hit = sums_by_text(covered(len(words.starts), starts, starts + sizes), words.first)
            names = [sorted({i for _, _, i in x}) for x in spans]
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(np.diff(words.first)), pa.array(hit), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array(hit > 0)],
                [x.split()[0] for x in RESULT.split(", ")],
            )

    found = matched(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), items, "text", item_id, item_text, window, containment)
    return found.mapInArrow(run, RESULT)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, containment: float = 1.0) -> DataFrame:
    """The rows, with all columns, in which no window of an item occurs."""
    into = fresh("_spans", docs.columns)
    return matched(docs, items, text, item_id, item_text, window, containment, into).where(F.size(into) == 0).drop(into)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[s:s + least({WINDOW}, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS u(s) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) AS k, unnest(range(1, len(w) - n + 2)) AS u(s)),
hits AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM places p JOIN win ON p.n = win.n AND p.g = win.g),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items, sha256(coalesce(x.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""
