"""Near copies by SimHash in pigeonhole blocks and by MinHash bands, verified by the Jaccard similarity of their shingle sets.

A text is the set of the 64-bit hashes of its ``SHINGLE``-word shingles (lower-cased words, each by its XXH64, which long patterned words do not make collide; a shorter text is one shingle of all its words).
Equal sets are one class before anything is joined. Each class has a SimHash fingerprint, and those within two bits of one another are
candidates by the blocks of ``simhash.links``. At a similarity of 0.8 some ten of 64 bits differ, which no choice of blocks finds, so bands
find the rest: of each class ``BANDS`` keys of ``ROWS`` minima are taken: two classes of similarity s
miss each other in all of them with probability (1 - s**ROWS)**BANDS, which is 1.3e-7 at 0.8 and less above. Classes that meet are linked where
the similarity of their sets, counted exactly, is at least ``SIMILAR``; groups are the components of these links.

In a key of at most ``BUCKET`` classes all pairs are verified. Classes of larger keys (copies of one text, or texts with one common passage) meet by an exact prefix filter among themselves instead:
their shingles are ordered by rarity, and two sets that are similar have one of their first n - ceil(0.8 n) + 1 in common, so a passage that many have brings nobody together, and what is left of both from there on must suffice, so many rare shingles keep texts apart. Of a shingle with many
classes still, first each class is verified against the most central classes that have it, those whose shingles are the commonest: near copies of one text are near copies of its middle, so this
brings most of a group into one component. Then whatever is not in the component of most of them meets the others where both have a rare shingle first, and the pair is made only if
their marks can be those of similar sets: the parities of how many shingles fall into each of 64 * ``MARKS`` parts. Shingles that both have cancel, so no two similar sets differ in more marks than shingles, and of short sets hardly any others in so few. From some 1,100 shingles on the marks tell no sets apart, and such pairs are all verified.
A group of some thousand shorter near copies so makes a few pairs for each of them, whether they are similar enough to be linked or just not; in larger ones the pairs still grow with the square, as a small part of all, and marks are compared pair by pair inside the join.

Null and empty texts have the empty set and are one class. Rows without an id keep null ids and belong to the class of their text; repeated rows
and ids belong to one class. Empty tables give empty results. A very long text is held by one task in a few times its size. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.llm._shared import cut, cut_narrow, narrowed, split_join
from graphloom.llm._text import LOWER, NON_SPACE, U64, Block, blocks, mix
from graphloom.llm.components import components
from graphloom.llm.licenses import grams
from graphloom.llm.simhash import grouped, majority, rows_of, xxh64_ranges

SHINGLE = 5
#: Parts of a hundred, so that the test is on whole numbers.
SIMILAR = 80
BANDS, ROWS = 40, 5
BUCKET = 8
#: Of so many of its rarest, and of its commonest, shingles that many have a class is verified against the picked ones.
ENDS = 2
#: 64-bit words of marks, by which pairs that differ in too many shingles are told apart where they meet.
MARKS = 8
SMALL_SETS = 32 << 20
#: Pairs that one task verifies.
TASK_PAIRS = 5000
#: Rows of a few numbers of crowds, which are joined over and over, that one task takes: fewer are not dealt anew at each step.
CROWD_ROWS = 1_000_000
#: Rows with bands, with fingerprints whose ten keys are made, and of crowds with marks and shingles, that one task takes, and bytes of sets.
BAND_ROWS, HEAD_ROWS, PLACED_ROWS, TASK_BYTES = 5000, 50_000, 20_000, 8 << 20
SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


def sets_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, and where those of each text begin (one more at the end)."""
    starts, ends, first = block.words(NON_SPACE)
    words, count = xxh64_ranges(LOWER[block.buf], starts, ends), np.diff(first)
    text = np.repeat(np.arange(len(block)), count)
    values, owners = [], []
    for n in range(1, SHINGLE + 1):
        whole = np.flatnonzero(count >= n if n == SHINGLE else count == n)
        g = grams(words, n)
        if n == SHINGLE:
            at = np.flatnonzero(text[: len(g)] == text[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        else:
            at = first[whole]
        values.append(mix(g[at] + U64(n)))
        owners.append(text[at])
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(block) + 1))


def digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    data = memoryview(values.tobytes())
    return np.array([xxhash.xxh64_intdigest(data[8 * a : 8 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], U64).view(np.int64)


def bands_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The band keys of each text, one row a text; those of empty sets are zero."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, BANDS), U64)
    for i, salt in enumerate(SALTS if len(full) else ()):
        out[full, i // ROWS] = mix(out[full, i // ROWS] + np.minimum.reduceat(values * salt, first[full]))
    return out.view(np.int64)


def prints_and_bands(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp (the digest of the shingle set), its size, SimHash fingerprint and bands, and d, if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, first = sets_of(block)
            bands = pa.ListArray.from_arrays(np.arange(len(block) + 1, dtype=np.int32) * BANDS, pa.array(bands_of(values, first).ravel()))
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(digests(values, first)), pa.array(np.diff(first).astype(np.int64)), pa.array(majority(values, first).view(np.int64)), bands, *block.rows.columns[2:]], ["doc_id", "fp", "size", "sim", "bands", "d"][: 3 + block.rows.num_columns])

    return rows_of(docs, doc_id, text, digest).mapInArrow(run, "doc_id long, fp long, size long, sim long, bands array<long>" + ", d binary" * digest)


def shingle_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """fp, held: of each row the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, first = sets_of(block)
            data = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(digests(values, first)), pa.array(data, pa.binary())], ["fp", "held"])

    return docs.select(docs[text].alias("text")).mapInArrow(run, "fp long, held binary")


def similar(a: bytes, b: bytes) -> bool:
    small, large = sorted((np.frombuffer(a, U64), np.frombuffer(b, U64)), key=len)
    if 100 * len(small) < SIMILAR * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= SIMILAR * (len(small) + len(large) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    with_sets = pairs.join(sets.select(F.col("fp").alias("u"), F.col("held").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("held").alias("b")), "v")
    return cut_narrow(with_sets.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def _able(places: bool = True) -> Column:
    """Whether sets (nu, nv shingles) can be similar by their sizes and, if they meet at places ru and rv of their shingles in one order, by what is left from there on, which must do where two similar sets meet first."""
    able = 100 * F.least("nu", "nv") >= SIMILAR * F.greatest("nu", "nv")
    return able & ((100 + SIMILAR) * (1 + F.least(F.col("nu") - F.col("ru"), F.col("nv") - F.col("rv"))) >= SIMILAR * (F.col("nu") + F.col("nv"))) if places else able


def _alike(pairs: DataFrame) -> DataFrame:
    """The pairs that can be similar, each once."""
    return pairs.where(_able("ru" in pairs.columns) & (F.col("u") < F.col("v"))).select("u", "v").distinct()


def _pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of the members (fp, size, and rank if they have one) of a key."""
    side = lambda x: members.select(*keys, F.col("fp").alias(x), F.col("size").alias(f"n{x}"), *([F.col("rank").alias(f"r{x}")] if "rank" in members.columns else []))
    return side("u").join(side("v"), keys)


def _few(rows: DataFrame) -> DataFrame:
    return cut_narrow(rows, CROWD_ROWS)


def prefixes(sets: DataFrame) -> DataFrame:
    """sets: fp, held. fp, size, mass, token, rank, m: the rarest shingles of each set, as many as a similar one must share one of, how many sets have them among theirs, and the sum of how many sets have each shingle of this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("held")]
            n = np.array([len(x) for x in held], np.int64)
            token = np.concatenate([np.zeros(0, np.int64), *held])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("fp").to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(token)], ["fp", "size", "token"])

    rows = cut(sets.mapInArrow(run, "fp long, size long, token long"))
    often = _few(rows.groupBy("token").agg(F.count("*").alias("df")))
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("df", "token"))
    first = split_join(rows, often, ["token"], "df").withColumn("rank", rank).withColumn("mass", F.sum("df").over(Window.partitionBy("fp"))).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * SIMILAR / 100) + 1)
    first = _few(first.where("df > 1").select("fp", "size", "mass", "token", "rank"))
    return _few(split_join(first, _few(first.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")), ["token"], "m"))


def _rooted(rows: DataFrame, good: DataFrame) -> DataFrame:
    """rows (fp, ...) with the component that each class has so far."""
    return rows.join(components(good).select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def marks(sets: DataFrame) -> DataFrame:
    """sets: fp, held. fp, marks: for each of 64 * MARKS parts of the shingles whether a set has an odd number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = [np.bincount((np.frombuffer(x.as_py(), U64) % U64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS).astype(np.uint8) & 1 for x in batch.column("held")]
            bits = np.packbits(np.concatenate([np.zeros(0, np.uint8), *odd])).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.ListArray.from_arrays(np.arange(len(odd) + 1, dtype=np.int32) * MARKS, pa.array(bits))], ["fp", "marks"])

    return sets.select("fp", "held").mapInArrow(run, "fp long, marks array<long>")


def _marked() -> Column:
    """Whether sets (nu, nv shingles, marks mu and mv) can be similar by their marks: each mark that differs is a shingle, at least, that one has and the other has not."""
    differ = reduce(Column.__add__, (F.bit_count(F.col("mu")[i].bitwiseXOR(F.col("mv")[i])) for i in range(MARKS)))
    return (100 + SIMILAR) * differ <= (100 - SIMILAR) * (F.col("nu") + F.col("nv"))


def picked_pairs(big: DataFrame) -> DataFrame:
    """u, v, nu, nv: each class next to the most central ones, by how common their shingles are on average and in all, of a few shingles that many have: its ENDS rarest and its ENDS commonest of these."""
    own = Window.partitionBy("fp")
    ends = big.withColumn("nth", F.row_number().over(own.orderBy("rank"))).withColumn("of", F.count("*").over(own)).where((F.col("nth") <= ENDS) | (F.col("nth") > F.col("of") - ENDS))
    centre = lambda by: F.max(F.struct(by.alias("by"), F.col("fp").alias("v"), F.col("size").alias("nv")))
    picked = big.groupBy("token").agg(F.array(centre(F.col("mass") / F.col("size")), centre(F.col("mass").cast("double"))).alias("p"), F.count("*").alias("m"))
    met = split_join(ends.select("token", "fp", "size"), _few(picked), ["token"], "m").select("fp", "size", F.explode("p").alias("p")).where("fp <> p.v")
    return met.select(F.least("fp", "p.v").alias("u"), F.greatest("fp", "p.v").alias("v"), F.col("size").alias("nu"), F.col("p.nv").alias("nv"))


def crowd_links(sets: DataFrame, good: DataFrame) -> DataFrame:
    """Links between the classes of the sets (fp, held), next to those that are known. Sets of at most SMALL_SETS bytes go to all tasks, so that pairs need not be dealt with the sets of both."""
    sets = cut(sets)
    held = sets.agg(F.sum(F.octet_length("held"))).first()[0] or 0
    sets = narrowed(sets, held, TASK_BYTES)
    members = prefixes(sets)
    if held <= SMALL_SETS:
        sets = F.broadcast(sets)
    pairs = _pairs(members.where(F.col("m") <= BUCKET).drop("mass"), ["token"]).where(_able()).select("u", "v", "nu", "nv")
    big = members.where(F.col("m") > BUCKET)
    if not big.limit(1).count():
        return good.union(verified(cut_narrow(_alike(pairs), TASK_PAIRS), sets))
    good = good.union(verified(cut_narrow(_alike(pairs.union(picked_pairs(big))), TASK_PAIRS), sets))
    # All rare shingles of a class in their order: a pair is made where it meets first, and nowhere else.
    rarest = members.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("p")).select("fp", F.transform("p", lambda x: x["token"]).alias("p"))
    placed = cut_narrow(_rooted(big.drop("mass"), good).join(rarest.join(marks(sets), "fp"), "fp"), PLACED_ROWS)
    most = placed.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("root", "c").alias("home"), F.sum("c").alias("m"))
    away = split_join(placed.drop("m"), _few(most), ["token"], "m").where("root <> home").select("token", F.col("fp").alias("u"), F.col("size").alias("nu"), F.col("rank").alias("ru"), F.col("p").alias("pu"), F.col("marks").alias("mu"), F.col("root").alias("from"))
    rest = away.join(placed.select("token", F.col("fp").alias("v"), F.col("size").alias("nv"), F.col("rank").alias("rv"), F.col("p").alias("pv"), F.col("marks").alias("mv"), "root"), "token")
    rest = rest.where((F.col("root") != F.col("from")) & _able() & _marked() & (F.get(F.array_intersect("pu", "pv"), F.lit(0)) == F.col("token")))
    rest = rest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "nu", "nv")  # the conditions on both sides are the same either way round
    return good.union(verified(cut_narrow(_alike(rest), TASK_PAIRS), sets))


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """u, v, nu, nv: of classes (fp, size, sim) whose fingerprints are linked, or the same, pairs that join them all."""
    full = classes.where("size > 0").select("fp", "size", "sim")
    heads = cut_narrow(full.groupBy("sim").agg(F.min(F.struct("fp", "size")).alias("h"), F.count("*").alias("n")), HEAD_ROWS)
    head = lambda x: heads.select(F.col("sim").alias(x), F.struct("h.*").alias(f"h{x}"))
    linked = simhash.links(heads.select(F.col("sim").alias("fp"))).join(head("u"), "u").join(head("v"), "v").select("hu", "hv")
    same = split_join(full, heads.where("n > 1"), ["sim"], "n").select(F.struct("fp", "size").alias("hu"), F.struct("h.*").alias("hv"))
    both = linked.union(same).where("hu.fp <> hv.fp").select(F.least("hu", "hv").alias("a"), F.greatest("hu", "hv").alias("b"))
    return both.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"), F.col("a.size").alias("nu"), F.col("b.size").alias("nv"))


def links(classes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """u, v: links of classes (fp, size, sim, bands) whose components are those of all similar pairs that are near by fingerprint or share a band."""
    keyed = classes.select("fp", "size", F.posexplode("bands").alias("k", "bits"))
    shared = _few(keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    members = _few(split_join(keyed, shared, ["k", "bits"], "n"))
    crowd = _few(members.where(F.col("n") > BUCKET).select("fp").distinct())
    banded = _pairs(members.where(F.col("n") <= BUCKET), ["k", "bits"]).select("u", "v", "nu", "nv")
    pairs = cut_narrow(_alike(banded.union(simhash_pairs(classes))), TASK_PAIRS)
    met = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).union(crowd).distinct()
    sets = cut(shingle_sets(docs, text).join(met, "fp", "left_semi").groupBy("fp").agg(F.first("held").alias("held")))
    good = verified(pairs, sets)
    return crowd_links(sets.join(crowd, "fp", "left_semi"), good) if crowd.limit(1).count() else good


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp, component_id: of each row, with the smallest id that links reach from it."""
    found = cut(prints_and_bands(docs, doc_id, text, digest))
    classes = cut_narrow(found.groupBy("fp").agg(F.first("size").alias("size"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), BAND_ROWS)
    return grouped(found.drop("size", "sim", "bands"), lambda _: links(classes, docs, text))
