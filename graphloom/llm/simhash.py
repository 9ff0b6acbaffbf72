"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are 64 majority bits of the XXH64 hashes of word shingles, computed with numpy over blocks of whole
texts. Equal fingerprints are one class before anything is joined, so exact copies cost one row. Each distinct
fingerprint is split into five blocks; two that differ in at most two bits agree in at least three of the five, so
they meet in at least one of the ten choices of three blocks. Those choices are the join keys (38 bits, so a key is
shared by chance only beyond 10**11 fingerprints), and each meeting pair is verified by its Hamming distance.
A key shared by more than ``BUCKET`` fingerprints is not paired: its fingerprints are placed at themselves and at
their 64 one-bit neighbours instead, where two within two bits always meet and where at most 65 can meet; each is
linked to the least one there, which keeps every component whole without pairs. No link is left out either way.

Null and empty texts have fingerprint zero and are linked like any other. Rows without an id keep null ids and belong
to their fingerprint's class; repeated rows and ids belong to one class. Empty tables give empty results. A very
long text is held by one task in a few times its size. Other columns are not read by ``near_duplicates`` and are
passed on by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._shared import content_digest, cut, cut_narrow, fresh, split_join
from graphloom.llm._text import LOWER, NON_SPACE, U64, Block, blocks
from graphloom.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
BUCKET = 32
#: So many rows that go, of some 60 bytes each, are sent to all tasks, so that the texts need not be shuffled.
FEW_GONE = 500_000
#: Low bit and width of the blocks of a fingerprint.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
# XXH64's published primes.
P1, P2, P3, P4, P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def xxh64_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of buf[starts[i]:ends[i]] for all i; ranges of one length are hashed together."""
    out, size = np.empty(len(starts), U64), ends - starts
    held = np.concatenate((buf, np.zeros(8, np.uint8)))
    wide = np.ndarray((len(held) - 7,), "<u8", held, 0, (1,))
    half = np.ndarray((len(held) - 3,), "<u4", held, 0, (1,))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts) if len(order) else ():
        n, at = int(size[group[0]]), starts[group]
        if n > 256 or len(group) < 4:
            data = memoryview(held)
            out[group] = [xxhash.xxh64_intdigest(data[int(a) : int(a) + n], seed) for a in at]
            continue
        i = 0
        if n >= 32:
            lanes = [np.full(len(at), x, U64) for x in (U64((seed + int(P1) + int(P2)) % 2**64), U64((seed + int(P2)) % 2**64), U64(seed), U64((seed - int(P1)) % 2**64))]
            while n - i >= 32:
                for k in range(4):
                    lanes[k] = _rot(lanes[k] + wide[at + (i + 8 * k)] * P2, 31) * P1
                i += 32
            h = _rot(lanes[0], 1) + _rot(lanes[1], 7) + _rot(lanes[2], 12) + _rot(lanes[3], 18)
            for x in lanes:
                h = (h ^ (_rot(x * P2, 31) * P1)) * P1 + P4
            h = h + U64(n)
        else:
            h = np.full(len(at), U64((seed + int(P5) + n) % 2**64), U64)
        while n - i >= 8:
            h = _rot(h ^ (_rot(wide[at + i] * P2, 31) * P1), 27) * P1 + P4
            i += 8
        if n - i >= 4:
            h = _rot(h ^ (half[at + i].astype(U64) * P1), 23) * P2 + P3
            i += 4
        while i < n:
            h = _rot(h ^ (held[at + i].astype(U64) * P5), 11) * P1
            i += 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        out[group] = h ^ (h >> U64(32))
    return out


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each range hashes[first[i]:first[i + 1]] the bits that are set in over half of it.

    Eight bits are summed in one 64-bit word, in runs short enough for its bytes not to overflow."""
    size = np.diff(first)
    runs = np.maximum(1, -(-size // 255)) * (size > 0)
    owner = np.repeat(np.arange(len(size)), runs)
    at = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs))
    value = np.zeros(len(size), U64)
    if not len(owner):
        return value
    begins = np.flatnonzero(np.concatenate(([True], np.diff(owner) > 0)))
    full = owner[begins]
    for bit in range(8):
        packed = np.add.reduceat((hashes >> U64(bit)) & U64(0x0101010101010101), at)
        count = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), begins, axis=0)
        over = 2 * count > size[full][:, None]
        value[full] |= (over.astype(U64) << (np.arange(8, dtype=U64) * U64(8) + U64(bit))).sum(axis=1, dtype=U64)
    return value


def fingerprints_of(block: Block) -> np.ndarray:
    """The fingerprint of each text of a block: lower-cased words joined by single spaces, in shingles."""
    starts, ends, first = block.words(NON_SPACE)
    inside = NON_SPACE[block.buf]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    place = np.cumsum(keep) - 1
    buf = np.where(inside, LOWER[block.buf], np.uint8(32))[keep]
    starts, ends = place[starts] if len(starts) else starts, (place[ends - 1] + 1) if len(ends) else ends
    count = np.diff(first)
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    begins = np.concatenate(([0], np.cumsum(shingles)))
    word = np.repeat(first[:-1] - begins[:-1], shingles) + np.arange(begins[-1])
    last = word + np.repeat(np.minimum(count, SHINGLE), shingles) - 1
    return majority(xxh64_ranges(buf, starts[word], ends[last]), begins)


def rows_of(docs: DataFrame, doc_id: str, text: str, digest: bool = False) -> DataFrame:
    """doc_id, text and, if wanted, d: 128 bits of the text's SHA-256, which tell rows of one id apart."""
    d = [content_digest(docs[text]).alias("d")] if digest else []
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), *d)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long; and d, if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(fingerprints_of(block).view(np.int64)), *block.rows.columns[2:]], ["doc_id", "fp", "d"][: block.rows.num_columns])

    return rows_of(docs, doc_id, text, digest).mapInArrow(run, "doc_id long, fp long" + ", d binary" * digest)


def links(distinct: DataFrame) -> DataFrame:
    """u, v: links of distinct fingerprints (fp) whose components are those of all pairs within two bits."""
    fp = F.col("fp")
    keys = []
    for k, chosen in enumerate(combinations(BLOCKS, len(BLOCKS) - DISTANCE)):
        mask = sum(((1 << width) - 1) << low for low, width in chosen)
        keys.append(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(mask - (mask >> 63 << 64))).alias("bits")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.*")
    shared = keyed.groupBy("k", "bits").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    shared = cut_narrow(shared)
    two = shared.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    members = cut_narrow(keyed.join(shared.where("n > 2").select("k", "bits", "n"), ["k", "bits"]))
    few = members.where(F.col("n") <= BUCKET)
    pairs = few.select("k", "bits", fp.alias("u")).join(few.select("k", "bits", fp.alias("v")), ["k", "bits"]).where("u < v").select("u", "v")
    pairs = two.union(pairs).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    crowd = members.where(F.col("n") > BUCKET).select("fp").distinct()
    places = crowd.select("fp", F.explode(F.array(fp, *(fp.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)))).alias("place"))
    met = places.groupBy("place").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u < v")
    return pairs.union(stars).distinct()


def grouped(prints: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, fp, component_id and root (of all rows of a group the same fp) of rows (doc_id, fp, others), where linked gives the links (u, v) of distinct fingerprints (fp)."""
    classes = cut_narrow(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    roots = components(linked(classes.select("fp")))
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut_narrow(rooted.select("fp", "n", "root").join(least, "root").select("fp", "n", "root", "component_id"))
    return split_join(prints, named, ["fp"], "n").select("doc_id", "fp", "component_id", "root", *[c for c in prints.columns if c not in ("doc_id", "fp")])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp, component_id: of each row, with the smallest id that links reach from it."""
    prints = cut(fingerprints(docs, doc_id, text, digest))
    return grouped(prints, links)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """Of each group one row, with all columns: that with the smallest id (none is last), of those with one id that with the least digest of its text, of rows
    equal in both any one. The groups are those of near_duplicates, or of another function with its results."""
    found = cut_narrow(groups(docs, doc_id, text, True))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "d")
    first = cut_narrow(found.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"))
    met = split_join(found, first, ["root"], "n")
    gone = cut_narrow(met.where(~order.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("_gone"), F.col("d").alias("_of")).distinct())
    if gone.count() <= FEW_GONE:
        gone = F.broadcast(gone)
    d = fresh("d", docs.columns)
    kept = docs.withColumn(d, content_digest(docs[text]))
    kept = kept.join(gone, kept[doc_id].cast("long").eqNullSafe(gone["_gone"]) & (kept[d] == gone["_of"]), "left_anti")
    if met.where(order.eqNullSafe(F.col("first"))).groupBy("root").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([doc_id, d])
    return kept.drop(d)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
