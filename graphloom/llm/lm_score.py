"""Cross-entropy difference of matched bigram models.

A target model (documents labelled good) and a background model (all other documents) share one vocabulary: ``CLASSES``
hash classes, in one of which each lower-cased word falls. They are matched: same order and smoothing, and the background's counts are
scaled to the target's number of tokens. A document is scored by the mean over its tokens of its loss under the target less its
loss under the background; its own tokens are left out of the counts it is scored by, so that neither model has seen it.

    P(w | h) = (s c(h, w) + MASS / CLASSES) / (s c(h) + MASS), h the class of the word before, or of the start

Counts are too many for any one task, and so is a copy of them for each. Tasks sort the bigrams of a block of documents and send each part of
the bigrams (by context) one packed row with the block's bigrams and the documents that hold them. A part adds up its rows, so has the corpus counts of
its bigrams and contexts, and answers each block with its share of each document's two losses; the shares of a block are added at last.
There are as many parts as keep the tokens of one near ``PART_TOKENS``. Contexts with a share ``HOT_SHARE`` of all tokens or more would be too many for one part:
they are spread by both words, and their counts (two numbers for each of at most 2 / HOT_SHARE + 1) are added up before and sent to all tasks.

Null and empty texts have no tokens and null scores. Rows without label, with a null label or without an id belong to the background; a
document labelled twice belongs to the target if any label says so. Repeated rows are documents of their own. With no target or no background
that model is uniform. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._shared import cut, partitions
from graphloom.llm._text import ALNUM, LOWER, U64, Block, blocks, hash_ranges, mix

BITS = 24
CLASSES = 1 << BITS
MASS = 50.0
#: The share of tokens from which a context is spread.
HOT_SHARE = 1 / 1024
#: Tokens in one part of the bigrams, about.
PART_TOKENS = 4_000_000
#: Bytes and texts of a block; texts are numbered by 16 bits.
BLOCK, BLOCK_TEXTS = 4 << 20, (1 << 16) - 1
#: More label rows than these are joined instead of sent to all tasks.
FEW_LABELS = 1_000_000
START = CLASSES - 1


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words of a block, and the number of each text's first word."""
    starts, ends, first = block.words(ALNUM)
    return (hash_ranges(LOWER[block.buf], starts, ends) >> U64(64 - BITS)).astype(np.int64), first


def _pack(*arrays: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed."""
    planes = [np.ascontiguousarray(a.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T).tobytes() for a, w in zip(arrays, WIDTHS, strict=True)]
    return zstandard.ZstdCompressor(1).compress(np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 8 * len(WIDTHS), []
    for n, w in zip(np.frombuffer(data, "<i8", len(WIDTHS)).tolist(), WIDTHS, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T).view(f"<u{w}").ravel().astype(np.int64 if w == 8 else np.int32))
        at += n * w
    return out


#: Bytes of: bigram steps, documents of each, document, times, times of the context in the document.
WIDTHS = (8, 4, 4, 4, 4)
ASK = "part int, block long, blob binary, target binary, ids array<long>, sizes array<int>"
ANSWER = "block long, blob binary, ids array<long>, sizes array<int>"
RESULT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def before(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The context of each word."""
    out = np.concatenate(([START], words[:-1]))
    out[first[:-1][np.diff(first) > 0]] = START
    return out[: len(words)]


def _ask(rows: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """A row for each block and each part of which it has bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in blocks(batches, "text", BLOCK, BLOCK_TEXTS):
            words, first = tokens(block)
            text = np.repeat(np.arange(len(block)), np.diff(first))
            target = np.asarray(block.rows.column(2).to_pylist(), bool)
            code, times = np.unique(((before(words, first) << BITS | words).astype(U64) << U64(16)) | text.astype(U64), return_counts=True)
            bigram, doc = (code >> U64(16)).astype(np.int64), (code & U64(0xFFFF)).astype(np.int64)
            _, back = np.unique(doc << BITS | bigram >> BITS, return_inverse=True)
            own = np.bincount(back, times, len(back) or 1).astype(np.int64)[back]
            context = bigram >> BITS
            at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            is_hot = hot[at] == context
            part = (mix(np.where(is_hot, bigram, context).astype(U64)) % U64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            held = part[order]
            cuts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.zeros(0, np.int64)
            packed, rows = np.packbits(target).tobytes(), []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(held)], strict=False):
                pick = order[a:b]
                found = bigram[pick]
                new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
                rows.append((int(held[a]), number, _pack(np.diff(found[new], prepend=0), np.diff(np.append(new, len(found))), doc[pick], times[pick], own[pick]), packed, None, None))
            none = np.zeros(0, np.int64)
            rows.append((number % parts, number, _pack(none, none, none, none, none), packed, block.rows.column(0).to_pylist(), np.diff(first).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)], [x.split()[0] for x in ASK.split(", ")])
            number += 1

    return rows.mapInArrow(run, ASK)


def _answer(asked: DataFrame, hot: np.ndarray, totals: np.ndarray, classes: int, mass: float) -> DataFrame:
    """Adds up a part's counts, and gives each block its documents' losses on the part's bigrams."""

    def group(table: pa.Table) -> pa.Table:
        n_target, n_background = totals[-2:]
        scale = n_target / n_background if n_background else 0.0
        parts = [_unpack(x) for x in table["blob"].to_pylist()]
        bigrams = np.concatenate([np.repeat(np.cumsum(p[0]), p[1]) for p in parts])
        doc, times, own = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        size = np.array([len(p[2]) for p in parts])
        del parts
        bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in table["target"].to_pylist()]
        base = np.concatenate(([0], np.cumsum([len(b) for b in bits])))
        good = np.concatenate(bits)[doc + np.repeat(base[:-1], size)].astype(bool)
        known, back = np.unique(bigrams, return_inverse=True)
        del bigrams
        contexts, of = np.unique(known >> BITS, return_inverse=True)
        place = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
        is_hot, loss = hot[place] == contexts, []
        for mine, shift, factor in ((good, 0, 1.0), (~good, len(hot), scale)):
            pair = np.bincount(back, times * mine, len(known))
            context = np.where(is_hot, totals[shift + place], np.bincount(of, pair, len(contexts)))
            each = np.log(factor * (context[of[back]] - own * mine) + mass)
            each -= np.log(factor * (pair[back] - times * mine) + mass / classes)
            loss.append((times * each).astype(np.float32))
            del each
        out, at = [], 0
        for k, n in enumerate(size.tolist()):
            docs, where = np.unique(doc[at : at + n], return_inverse=True)
            sums = [np.bincount(where, x[at : at + n], len(docs)).astype("<f4").tobytes() for x in loss]
            out.append(zstandard.ZstdCompressor(1).compress(np.diff(docs, prepend=0).astype("<u4").tobytes() + b"".join(sums)))
            at += n
        return pa.table({"block": table["block"], "blob": pa.array(out, pa.binary()), "ids": table["ids"], "sizes": table["sizes"]})

    return asked.groupBy("part").applyInArrow(group, ANSWER)


def _add(answers: DataFrame) -> DataFrame:
    def group(table: pa.Table) -> pa.Table:
        ids, sizes = ([x for y in table[c].to_pylist() if y is not None for x in y] for c in ("ids", "sizes"))
        loss = np.zeros((2, len(ids)))
        for blob in table["blob"].to_pylist():
            data = zstandard.ZstdDecompressor().decompress(blob)
            n = len(data) // 12
            docs = np.cumsum(np.frombuffer(data, "<u4", n).astype(np.int64))
            loss[:, docs] += np.frombuffer(data, "<f4", 2 * n, 4 * n).reshape(2, n)
        n = np.array(sizes, np.int64)
        mean = [pa.array(x / np.maximum(n, 1), mask=n == 0) for x in (*loss, loss[0] - loss[1])]
        return pa.table([pa.array(ids, pa.int64()), pa.array(n), *mean], [x.split()[0] for x in RESULT.split(", ")])

    return answers.groupBy("block").applyInArrow(group, RESULT)


def frequent(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Classes of the frequent contexts, ascending (the start is one), and the number of tokens.

    A block reports the classes with half the share or more of its tokens. What it does not report of a class is less than half the share, so each class
    with the share in all has at least half of it reported; these are taken, at most 2 / HOT_SHARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK, BLOCK_TEXTS):
            words = tokens(block)[0]
            word, n = np.unique(words, return_counts=True)
            often = 2 * n >= HOT_SHARE * len(words)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[often], -1)), pa.array(np.append(n[often], len(words)))], ["word", "n"])

    counts = cut(rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where("word = -1").agg(F.sum("n")).first()[0] or 0
    top = counts.where((F.col("word") >= 0) & (2 * F.col("n") >= HOT_SHARE * total)).collect()
    return np.array(sorted({r.word for r in top} | {START}), np.int64), total


def context_totals(rows: DataFrame, hot: np.ndarray) -> np.ndarray:
    """How often each hot context occurs in the target, then in the background, then the tokens of both."""
    size = len(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2 * size + 2, np.int64)
        for block in blocks(batches, "text", BLOCK, BLOCK_TEXTS):
            words, first = tokens(block)
            good = np.repeat(np.asarray(block.rows.column(2).to_pylist(), bool), np.diff(first))
            context = before(words, first)
            at = np.minimum(np.searchsorted(hot, context), size - 1)
            is_hot = hot[at] == context
            for k, mine in enumerate((good, ~good)):
                found[k * size : (k + 1) * size] += np.bincount(at[is_hot & mine], minlength=size)
                found[2 * size + k] += mine.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], ["at", "n"])

    out = np.zeros(2 * size + 2, np.int64)
    for at, n in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # at most 4 / HOT_SHARE + 4 rows
        out[at] = n
    return out


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", classes: int = CLASSES, mass: float = MASS) -> DataFrame:
    """doc_id, n_tokens, mean losses under both models, and score (their difference: low is like the target)."""
    wanted = labels.groupBy(labels["doc_id"].alias("_id")).agg(F.max((F.coalesce(labels[label], F.lit(0)) == 1)).alias("_target")).where("_target AND _id IS NOT NULL")
    if labels.count() <= FEW_LABELS:
        wanted = F.broadcast(wanted)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    hot, total = frequent(rows)
    rows = rows.join(wanted, rows["doc_id"] == wanted["_id"], "left").select("doc_id", "text", F.coalesce("_target", F.lit(False)).alias("target"))
    parts = max(partitions(docs.sparkSession), -(-total // PART_TOKENS))
    return _add(_answer(_ask(rows, hot, parts), hot, context_totals(rows, hot), classes, mass))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
