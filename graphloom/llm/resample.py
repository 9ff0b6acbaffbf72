"""Importance resampling of documents towards a target distribution.

Equal texts are grouped by their full text, so features are hashed once for each distinct text and counted as often as it occurs. Features are runs of 1 to
``RUNS`` words, hashed to ``BUCKETS`` buckets; a bucket's gain compares the target's share of it with that of the documents, and a text's weight is the sum of the gains of its
features. Weights are joined back by a digest of the text before each document gets its own noise (Gumbel, from a hash of its id), so copies have one
weight, but are drawn by themselves. The highest scores are drawn: rows are dealt by ranges of score and id and sorted inside them, and a row's rank is its place in its range after the rows of
all ranges before, so no task sees more than a range.

The bucket numbers of a distinct text are written once, two bytes each, and read for the counts and for the weights. Gains are a table of ``BUCKETS`` numbers. The join back sends the hot texts to all tasks (split_join).

Null texts have no words: weight 0, and never drawn. Rows without an id have the noise of an empty one and come last among ties; repeated rows are
rows of their own, and those equal in all are ranked in any order. Empty tables give empty results; an empty target only moves the gains. A very long text is held by one task in a few times its size. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import content_digest, cut, drop, partitions, split_join, written
from graphloom.llm._text import ALNUM, LOWER, Block, blocks, sums_by_text

RUNS, BUCKETS, SEED = 1, 10_000, 2024
#: Texts of fewer words are not drawn; so many of a hundred of the others are.
MIN_WORDS, DRAWN = 20, 10
#: Longer words are hashed one by one.
SHORT = 24


def crc_table() -> np.ndarray:
    """The remainders of all bytes by the polynomial of CRC-32, reflected."""
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, (rest >> 1) ^ np.uint32(0xEDB88320), rest >> 1).astype(np.uint32)
    return rest


TABLE = crc_table()


def crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ranges of a buffer: byte by byte for all short ones at once, by the library for long ones."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    size = np.minimum(size, SHORT + 1)
    order = np.argsort(size, kind="stable")
    first = np.searchsorted(size[order], np.arange(SHORT + 2))
    state, at = out[order], starts[order]
    end = int(first[SHORT + 1])
    for k in range(SHORT):
        low = int(first[k + 1])
        if low >= end:
            break
        state[low:end] = TABLE[(state[low:end] ^ buf[at[low:end] + k]) & 0xFF] ^ (state[low:end] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[end:].tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes())
    return out


def features(block: Block, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text has, the buckets of all features text by text, and where those of each text begin (one more at the end)."""
    starts, ends, first = block.words(ALNUM)
    size = ends - starts
    # The words alone, each followed by a space: a run is a range of these.
    after = np.cumsum(size + 1)
    buf = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    inside = np.ones(len(buf), bool)
    inside[after - 1] = False
    edge = np.zeros(len(block.buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    buf[inside] = LOWER[block.buf][np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    begin, n = after - size - 1, np.diff(first)
    text = np.repeat(np.arange(len(block)), n)
    values, owners = [], []
    for k in range(1, runs + 1):
        at = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :]) if len(text) >= k else np.zeros(0, np.int64)
        values.append(crc32(buf, begin[at], after[at + k - 1] - 1) % np.uint32(buckets))
        owners.append(text[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable") if runs > 1 else slice(None)
    return n, np.concatenate(values)[order], np.searchsorted(owner[order], np.arange(len(block) + 1))


def kind_of(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def hashed(texts: DataFrame, runs: int, buckets: int) -> DataFrame:
    """texts: text, m, d. d, m, n_words, n_features, held (the buckets of the features, two or four bytes each) of distinct texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            n, found, first = features(block, runs, buckets)
            found = found.astype(kind_of(buckets))
            held = pa.array([found[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([block.rows.column(2), block.rows.column(1), pa.array(n.astype(np.int64)), pa.array(np.diff(first).astype(np.int64)), held], ["d", "m", "n_words", "n_features", "held"])

    return texts.select("text", "m", "d").mapInArrow(run, "d binary, m long, n_words long, n_features long, held binary")


def _distinct(rows: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(rows[text].cast("string"), F.lit(""))
    return rows.select(t.alias("text")).groupBy("text").agg(F.count("*").alias("m")).withColumn("d", content_digest(F.col("text")))


def held_in(column: pa.BinaryArray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket numbers of all texts, and where those of each begin (one more at the end)."""
    kind = np.dtype(kind_of(buckets))
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // kind.itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, kind, len(data) // kind.itemsize) if data is not None else np.zeros(0, kind)
    return values[first[0] : first[-1]], first - first[0]


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has, copies counted; one row a bucket comes to the driver."""


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            values, first = held_in(batch.column(0), buckets)
            often = np.repeat(batch.column(1).to_numpy(), np.diff(first))
            for m in np.unique(often):
                total += m * np.bincount(values[often == m], minlength=buckets)
        has = np.flatnonzero(total)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("held", "m").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain, in thousandths: how much more frequent it is in the target than in the documents, one added to each count."""
    b = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> tuple[DataFrame, list[str]]:
    """d, m, n_words, n_features, weight of the distinct texts of docs, and the folders that hold them."""
    found, folder = written(hashed(_distinct(docs, text), runs, buckets), "features")
    aimed, other = written(hashed(_distinct(target, target_text), runs, buckets), "target")
    gain = gains(bucket_counts(found, buckets), bucket_counts(aimed, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, first = held_in(batch.column(batch.schema.get_field_index("held")), buckets)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums_by_text(gain[values], first))], [*names, "weight"])

    names = ["d", "m", "n_words", "n_features"]
    return found.mapInArrow(run, "d binary, m long, n_words long, n_features long, weight long"), [folder, other]


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = SEED, per_cent: int = DRAWN, min_words: int = MIN_WORDS, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1; null if not drawn) of all rows of docs."""
    found, folders = weights(docs, target, text, target_text, runs, buckets)
    table = cut(found)
    for folder in folders:
        drop(docs.sparkSession, folder)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), content_digest(docs[text]).alias("d"))
    met = split_join(rows, table, ["d"], "m").select("doc_id", "n_words", "n_features", "weight")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = cut(met.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row")))
    able = scored.where(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    # The number of a row is its range and its place in it.
    ranged = able.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("at"))
    ranged = cut(ranged)
    part = F.shiftright("at", 33).alias("part")
    sizes = cut(ranged.groupBy(part).agg(F.count("*").alias("size")))
    drawn = per_cent * (sizes.agg(F.sum("size")).first()[0] or 0) // 100
    # One row a partition.
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = ranged.withColumn("part", part).join(F.broadcast(before), "part").select(*names, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.union(scored.where(F.col("n_words") < min_words).select(*names, F.lit(None).cast("long").alias("rank")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# CRC-32 of the distinct words byte by byte.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS r FROM documents),
dw AS (SELECT r, unnest(words) AS word FROM d), dc AS (SELECT r, word, count(*) AS n FROM dw GROUP BY ALL),
bc AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY word),
bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
vocab AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM dc UNION ALL SELECT word FROM bc)),
crc AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM vocab, tab),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM dc JOIN crc USING (word) GROUP BY bucket), t AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS t FROM bc JOIN crc USING (word) GROUP BY bucket),
al AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS sa, coalesce((SELECT sum(t) FROM t), 0) AS ta),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (sa + 10000) / ((s + 1) * (ta + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), al),
w AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM dc JOIN crc USING (word) JOIN g USING (bucket) GROUP BY r),
v AS (SELECT doc_id, r, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM k"""
