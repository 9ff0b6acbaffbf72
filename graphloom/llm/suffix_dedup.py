"""Removal of long repeated strings by a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes (a window) that also starts anywhere else. Each window has an anchor, the place in it where
a ``GRAM``-byte string has the least hash (the first of equals) and ``LEAD`` bytes still follow. Equal windows have equal anchors at equal places,
so only the suffixes that start at anchors are indexed, about one in ``(LENGTH - LEAD) / 2`` bytes. The windows of an anchor are consecutive; together they are its stretch.

The documents are indexed in batches. The suffix array of a batch is ordered by the digest of a suffix's first ``LEAD`` bytes (key): any order serves in
which suffixes with equal leading bytes are neighbours. Neighbours with one key are a run, kept as their number and the least and
greatest digest of their stretches. A new array is merge-scanned with all levels of the family, which finds the runs that it takes part in; then it becomes a level of
its own, and levels of one size merge into the next, so that a suffix is written a logarithmic number of times.

A run whose stretches are all equal (one digest of key and of stretch, 128 bits of BLAKE2b together) is repeated as a whole. The suffixes of other runs are fetched
with their bytes and put in true suffix order, where the common prefixes of neighbours (and the common suffixes of what comes before the anchors)
tell which windows are equal, byte by byte. Runs of over ``FEW`` suffixes are not held by one task: blocks of ``WIDE`` windows are compared by
digests (128 bits) of what all their windows share, and of all they cover, and only blocks that the first finds and the second does not settle are compared window by window.

Shorter passages that another text has as well are counted, not removed: each string of ``PASSAGE`` bytes holds a sampled one of ``PASSAGE_LEAD`` bytes, and
``n_passages`` says how many of a text's sampled strings some other text has.

Documents are judged on the input: first and later occurrences go alike. Null and empty texts have no bytes; repeated rows are repeats of one
another, also with one id or none; empty tables give no rows. A task indexes a text twice at most however often it holds it: that it is repeated is then known.
A very long text is cut into overlapping segments. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._shared import content_digest, cut, drop, partitions, split_join, written
from graphloom.llm._text import CHUNK, U64, Block, Rolling, as_bytes, blocks, covered, mix

LENGTH = 400
LEAD = 128
GRAM = 32
PASSAGE, PASSAGE_LEAD = 200, 120
BATCHES = 4
FEW = 512
WIDE = 17
#: Places in one group of runs with few suffixes each, at most (and one run more).
GROUP_PLACES = 4_000
NONE = U64(0xFFFFFFFFFFFFFFFF)
ENTRIES = "d binary, off array<int>, x array<int>, n array<int>, key array<long>, span array<long>, passages array<long>"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values: least so far from the left and from the right of blocks of that width."""
    x = np.full(-(-len(values) // width) * width, NONE)
    x[: len(values)] = values
    x = x.reshape(-1, width)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def digests(buf: memoryview, starts: np.ndarray, ends: np.ndarray, size: int = 8) -> bytes:
    make = hashlib.blake2b
    return b"".join([make(buf[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def anchors(block: Block, length: int = LENGTH, lead: int = LEAD, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each anchor of a block: text, first window (bytes into the text), bytes from there to the anchor, number of windows, key and span."""
    out, step, width, view = [], CHUNK - length + 1, length - lead + 1, memoryview(block.buf)
    for low in range(0, max(1, len(block.buf) - length + 1), step):
        buf = block.buf[low : low + CHUNK]
        if len(buf) < length:
            break
        grams = Rolling(buf).windows(gram)[: len(buf) - lead + 1]
        low_bits = U64((1 << 21) - 1)
        chosen = (sliding_min((grams & ~low_bits) | np.arange(len(grams), dtype=U64), width) & low_bits).astype(np.int64)
        at = np.arange(len(chosen)) + low
        text = block.text_of(at)
        chosen[at + length > block.first[text + 1] - 1] = -1
        begin = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        end = np.concatenate((begin[1:], [len(chosen)]))
        good = chosen[begin] >= 0
        begin, end = begin[good], end[good]
        place, n, x = chosen[begin] + low, end - begin, chosen[begin] - begin
        key = np.frombuffer(digests(view, place, place + lead), "<i8")
        span = np.frombuffer(digests(view, begin + low, end - 1 + length + low), "<u8") ^ mix((x << 32 | n).astype(U64))
        text = text[begin]
        out.append((text, begin + low - block.first[text], x, n, key, span.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6


def passages(block: Block, length: int = PASSAGE, lead: int = PASSAGE_LEAD, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the sampled strings, each once a text."""
    found, step, width = [], CHUNK - length + 1, length - lead + 1
    for low in range(0, max(1, len(block.buf) - length + 1), step):
        buf = block.buf[low : low + CHUNK]
        if len(buf) < length:
            break
        rolling, low_bits = Rolling(buf), U64((1 << 21) - 1)
        grams = rolling.windows(gram)[: len(buf) - lead + 1]
        chosen = (sliding_min((grams & ~low_bits) | np.arange(len(grams), dtype=U64), width) & low_bits).astype(np.int64)
        at = np.arange(len(chosen)) + low
        text = block.text_of(at)
        good = at + length <= block.first[text + 1] - 1
        new = good & np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))
        found.append((text[new], rolling.windows(lead)[chosen[new]].view(np.int64)))
    text, key = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[new], key[new]


def entries(rows: DataFrame, length: int, lead: int, gram: int) -> DataFrame:
    """The anchors and sampled strings of each text (d, text); a task leaves out what it has met twice."""

    def lists(text: np.ndarray, n: int, values: list[np.ndarray], kinds: list[pa.DataType]) -> list[pa.Array]:
        cuts = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
        return [pa.ListArray.from_arrays(cuts, pa.array(v, t)) for v, t in zip(values, kinds, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Counter()
        for block in blocks((_fresh(b, met, min(length, PASSAGE)) for b in batches), "text"):
            text, *values = anchors(block, length, lead, gram)
            held, keys = passages(block)
            columns = lists(text, len(block), values, [pa.int32()] * 3 + [pa.int64()] * 2) + lists(held, len(block), [keys], [pa.int64()])
            yield pa.RecordBatch.from_arrays([block.rows.column(0), *columns], [x.split()[0] for x in ENTRIES.split(", ")])

    return rows.mapInArrow(run, ENTRIES)


def shared_passages(lists: DataFrame) -> DataFrame:
    """d, n_passages: the sampled strings of a text that come from somewhere else too."""
    keyed = lists.select("d", F.explode("passages").alias("k"))
    often = cut(keyed.groupBy("k").agg(F.count("*").alias("times")).where("times > 1"))
    return split_join(keyed, often, ["k"], "times").groupBy("d").agg(F.size(F.collect_set("k")).cast("long").alias("n_passages"))


def _fresh(batch: pa.RecordBatch, met: Counter, length: int) -> pa.RecordBatch:
    """The rows whose text is long enough and was met less than twice before."""
    keep = []
    for d, size in zip(batch.column(0).to_pylist(), pc.binary_length(batch.column(1)).to_pylist(), strict=True):
        new = size >= length and met[d] < 2
        met[d] += new
        keep.append(new)
    return batch.filter(pa.array(keep, pa.bool_()))


class Family:
    """Levels of runs (key, lo, hi, c), sorted by key; a level of size k holds 2**k batches. `met` are the scans' findings."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.met = spark, [], []

    def add(self, batch: DataFrame) -> None:
        """Merge-scans the suffixes (key, span) of new documents with all levels and indexes them. The runs of a task are added up before
        they are moved, so that a common one is a row a task."""
        new = batch.select("key", F.col("span").alias("lo"), F.col("span").alias("hi"), F.lit(1).cast("long").alias("c"), F.lit(1).cast("long").alias("new"))
        old = [level.withColumn("new", F.lit(0).cast("long")) for _, level, _ in self.levels]
        scan, folder = written(_sum(_union([new, *old]), F.sum(F.col("c") * F.col("new")).alias("new")), "scan")
        self.met.append(cut(scan.where("c > 1 AND new > 0").drop("new")))
        size, merged, used = 0, [], []
        while self.levels and self.levels[-1][0] == size:
            _, level, below = self.levels.pop()
            merged, used, size = [*merged, level], [*used, below], size + 1
        if not self.levels:  # the scan has merged all there is
            rows = scan.drop("new")
        elif merged:
            rows = _sum(_union([_sum(batch.select("key", F.col("span").alias("lo"), F.col("span").alias("hi"), F.lit(1).cast("long").alias("c"))), *merged]))
        else:
            rows = _sum(new.drop("new"))
        level, below = written(rows.sortWithinPartitions("key"), "level")
        for x in [*used, folder]:
            drop(self.spark, x)
        self.levels.append((size, level, below))

    def runs(self) -> DataFrame:
        """key, lo, hi, c: the runs of two suffixes or more. The last scan that met a run saw all of it."""
        return cut(_union(self.met).groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("c").alias("c")))

    def close(self) -> None:
        for _, _, folder in self.levels:
            drop(self.spark, folder)


def _sum(rows: DataFrame, *more) -> DataFrame:
    return rows.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("c").alias("c"), *more)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def _bounds(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


HELD = "key long, span long, k long, c long, x int, n int, held binary"
HELD_NAMES = [x.split()[0] for x in HELD.split(", ")]


def _fetch(rows: DataFrame, copies: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The places with the bytes of their stretches; a place may come once from each task that holds its text."""
    by_doc = places.groupBy("d").agg(F.collect_list(F.struct("key", "span", "k", "c", "x", "n", "off")).alias("p"))
    met = split_join(rows, cut(by_doc.join(copies, "d")), ["d"], "copies").select("d", "text", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for d, text, found in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2), strict=True):
                if d not in seen:
                    seen.add(d)
                    p = found.values.flatten()
                    off, n = p[6].to_numpy(), p[5].to_numpy()
                    held = [text[a:b] for a, b in zip(off.tolist(), (off + n - 1 + length).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*p[:6], pa.array(held, pa.binary())], HELD_NAMES)

    return met.mapInArrow(run, HELD)


PARTS = "key long, span long, runs array<struct<a: int, b: int>>"
PART_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def neighbours(keys: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and text, and the length of each one's common prefix with the one before in that order (-1: another key)."""
    order = np.array(sorted(range(len(texts)), key=lambda i: (keys[i], texts[i])), np.int64)
    size = np.array([len(texts[i]) for i in order], np.int64)
    matrix = np.zeros((len(texts), int(size.max(initial=0)) + 1), np.uint8)
    at = np.repeat(np.arange(len(texts)) * matrix.shape[1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    matrix.ravel()[at] = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    differ = matrix[1:] != matrix[:-1]
    differ[:, -1] = True
    common = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    return order, np.concatenate(([-1], np.where(keys[order][1:] == keys[order][:-1], common, -1))) if len(texts) else size


def repeated(keys: np.ndarray, x: np.ndarray, n: np.ndarray, held: list[bytes], length: int) -> np.ndarray:
    """repeated[i, s]: whether window s of suffix i is also a window of another suffix with its key."""
    m, width = len(held), int(n.max(initial=0))
    right, right_common = neighbours(keys, [h[k:] for h, k in zip(held, x.tolist(), strict=True)])
    left, left_common = neighbours(keys, [h[:k][::-1] for h, k in zip(held, x.tolist(), strict=True)])
    out, of_right, of_left = np.zeros((m, width), bool), np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(int(x.max(initial=0)) + 1):  # windows that start d bytes before the anchor
        have = np.flatnonzero((d <= x) & (d > x - n))
        if len(have) > 1:
            of_right[right] = np.cumsum(right_common < length - d)
            of_left[left] = np.cumsum(left_common < d)
            _, back, count = np.unique(of_left[have] * (m + 1) + of_right[have], return_inverse=True, return_counts=True)
            out[have, x[have] - d] = count[back] > 1
    return out


def _few(held: DataFrame, groups: int, length: int) -> DataFrame:
    """key, span, runs of repeated windows, in groups of whole keys."""

    def group(table: pa.Table) -> pa.Table:
        key, span = table["key"].to_numpy(), table["span"].to_numpy()
        _, one = np.unique(np.stack([key, span]), axis=1, return_index=True)
        table = table.take(pa.array(one))
        n = table["n"].to_numpy().astype(np.int64)
        found = repeated(key[one], table["x"].to_numpy().astype(np.int64), n, table["held"].to_pylist(), length)
        runs = [[{"a": a, "b": b} for a, b in _bounds(f)] for f in found]
        return pa.table({"key": table["key"], "span": table["span"], "runs": pa.array(runs, PART_TYPE)})

    return held.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("g").applyInArrow(group, PARTS)


def _many(held: DataFrame, length: int) -> DataFrame:
    """As _few, for runs that no task should hold: blocks of windows first, then single windows."""

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, span, x, n, text in zip(*(batch.column(HELD_NAMES.index(c)).to_pylist() for c in ("key", "span", "x", "n", "held")), strict=True):
                d = np.arange((x - n + 1) // WIDE, x // WIDE + 1) * WIDE
                lo, hi, m = np.maximum(d, x - n + 1), np.minimum(d + WIDE - 1, x), memoryview(text)
                shared = digests(m, x - d, x + length - (d + WIDE - 1), 16)
                whole = digests(m, x - hi, x + length - lo, 16)
                cell = lambda s, i: s[16 * i : 16 * i + 16]
                full = (hi - lo == WIDE - 1).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(d), pa.int64()), pa.array([span] * len(d), pa.int64()), pa.array((x - hi).astype(np.int32)), pa.array((x - lo + 1).astype(np.int32)), pa.array([cell(shared, i) for i in range(len(d))], pa.binary()), pa.array([cell(whole, i) if f else None for i, f in enumerate(full)], pa.binary())], ["key", "span", "a", "b", "shared", "whole"])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, span, text, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at = np.concatenate([np.arange(p["a"], p["b"]) for p in parts])
                found = digests(memoryview(text), at, at + length, 16)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array([span] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array([found[16 * i : 16 * i + 16] for i in range(len(at))], pa.binary())], ["key", "span", "a", "h"])

    table, _ = written(held.dropDuplicates(["key", "span"]), "stretches")
    parts, _ = written(table.mapInArrow(wide, "key long, span long, a int, b int, shared binary, whole binary"), "blocks")
    often = cut(parts.where("whole IS NOT NULL").groupBy("whole").agg(F.count("*").alias("times")).where("times > 1"))
    marked, _ = written(split_join(parts, often, ["whole"], "times", "left"), "blocks")
    settled = marked.where("times IS NOT NULL").select("key", "span", "a", "b")
    met = cut(marked.groupBy("shared").agg(F.count("*").alias("n"), F.count_if(F.col("times").isNull()).alias("open")).where("n > 1 AND open > 0"))
    met = cut(split_join(marked, met, ["shared"], "n").select("shared", "whole", "key", "span", "a", "b", "times"))
    # A settled block still tells that windows of others are repeated: one of each kind is enough.
    known = met.where("times IS NOT NULL").groupBy("shared", "whole").agg(F.min(F.struct("key", "span", "a", "b")).alias("m")).select("m.*")
    open_ = met.where("times IS NULL").select("key", "span", "a", "b").union(known)
    by_place = open_.groupBy("key", "span").agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    windows, _ = written(table.join(by_place, ["key", "span"]).select("key", "span", "held", "parts").repartition(partitions(held.sparkSession)).mapInArrow(narrow, "key long, span long, a int, h binary"), "windows")
    twice = cut(windows.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"))
    single = split_join(windows, twice, ["h"], "times").select("key", "span", "a", (F.col("a") + 1).alias("b"))
    return settled.union(single).groupBy("key", "span").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>, n_passages long"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, lead: int = LEAD, gram: int = GRAM, n_batches: int = BATCHES, few: int = FEW) -> DataFrame:
    """One row a document: bytes, bytes removed, the removed runs (spans), the digest of what is left, and its shared passages."""
    spark, text_of = docs.sparkSession, F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), content_digest(text_of).alias("d"), text_of.alias("text"))
    lists, folder = written(entries(rows.select("d", "text"), length, lead, gram), "entries")
    places = lists.select("d", F.explode(F.arrays_zip("off", "x", "n", "key", "span")).alias("e")).select("d", "e.*")
    family = Family(spark)
    for k in range(n_batches):
        family.add(lists.where(F.pmod(F.xxhash64("d"), F.lit(n_batches)) == k).select(F.explode(F.arrays_zip("key", "span")).alias("e")).select("e.*"))
    met, met_folder = written(split_join(places, family.runs(), ["key"], "c"), "met")
    family.close()
    told = cut(shared_passages(lists))
    drop(spark, folder)
    whole = met.where("lo = hi").select("d", "off", "n", F.lit(0).alias("a"), F.col("n").alias("b"))
    mixed = met.where("lo < hi")
    some = cut(mixed.groupBy("key", "span").agg(F.count("*").alias("k"), F.first("c").alias("c"), F.min(F.struct("d", "off", "x", "n")).alias("p")).select("key", "span", "k", "c", "p.*"))
    copies = cut(rows.groupBy("d").agg(F.count("*").alias("copies")))
    held, held_folder = written(_fetch(rows.select("d", "text"), copies, some, length), "held")
    groups = max(partitions(spark), some.count() // GROUP_PLACES)
    found = _few(held.where(F.col("c") <= few), groups, length)
    if held.where(F.col("c") > few).limit(1).count():
        found = found.union(_many(held.where(F.col("c") > few), length))
    # A stretch that is found twice is repeated as a whole, whatever else its run holds.
    found = some.select("key", "span", "k").join(found, ["key", "span"], "left").select("key", "span", "k", F.when(F.col("k") > 1, F.lit(None)).otherwise(F.col("runs")).alias("runs"))
    found = cut(found.where("k > 1 OR size(runs) > 0"))
    some_met = split_join(mixed.select("d", "off", "n", "key", "span"), found, ["key", "span"], "k")
    part = some_met.select("d", "off", "n", F.explode(F.coalesce("runs", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))))).alias("r")).select("d", "off", "n", "r.*")
    hits = whole.union(part).select("d", (F.col("off") + F.col("a")).alias("start"), (F.col("off") + F.col("b") - 1 + length).alias("stop"))
    by_doc = hits.groupBy("d").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).join(told, "d", "full")
    by_doc, _ = written(by_doc.join(copies, "d"), "hits")
    drop(spark, met_folder)
    drop(spark, held_folder)
    return _apply(rows, by_doc)


def _apply(rows: DataFrame, by_doc: DataFrame) -> DataFrame:
    met = split_join(rows, by_doc, ["d"], "copies", "left").select("doc_id", "text", "spans", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))
    names = [x.split()[0] for x in RESULT.split(", ")[:5]] + ["spans", "n_passages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                starts, stops = (np.array([s[x] for s in spans or ()], np.int64) for x in ("start", "stop"))
                gone = covered(len(text), starts, stops) if len(starts) else np.zeros(len(text), bool)
                left = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(starts) else text
                runs = _bounds(gone)
                out.append((len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), [{"start": a, "stop": b} for a, b in runs]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ((),) * 5, kinds, strict=True)), batch.column(3)], names)

    return met.mapInArrow(run, RESULT)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
