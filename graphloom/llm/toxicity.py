"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models on the words of a text (whether a hash class of words occurs, scaled by how much
more often it does so in that category) and on the probabilities of the categories before it. For training, those probabilities are
out-of-fold predictions: each document's come from models that were fitted without its fold, as at prediction they
come from models that have not seen the document. The threshold of each category is the one that, on out-of-fold predictions, gives the best F1.

The chain is fitted on a bounded sample, the ``SAMPLE`` labelled documents whose ids come first by hash, on the driver;
the models are two arrays of ``CLASSES`` numbers, which bounds what is sent to all tasks. All documents are scored, whole, in one pass without a shuffle.

Null and empty texts have no words and get the probabilities of the intercepts. Null labels and labels of unknown documents are not
trained on; a document labelled twice is positive if any label is. With no labelled rows, or one class only, a category's probability is the share of positives (0 without rows).
Repeated rows are scored one by one. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._text import ALNUM, LOWER, U64, Block, blocks, hash_ranges, sums_by_text

BITS = 18
CLASSES = 1 << BITS
SAMPLE = 6000
FOLDS = 3
STEPS = 60
RIDGE = 0.3
#: Classes of words found in fewer documents of the sample are not used.
LEAST_DOCS = 3


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words of each text, each once, and where each text's begin."""
    starts, ends, first = block.words(ALNUM)
    word = (hash_ranges(LOWER[block.buf], starts, ends) >> U64(64 - BITS)).astype(np.int64)
    text = np.repeat(np.arange(len(block)), np.diff(first))
    found = np.unique(text << BITS | word)
    return found & (CLASSES - 1), np.searchsorted(found, np.arange(len(block) + 1) << BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Weights by class of words, intercept, and weights of the logits of earlier categories."""

    words: np.ndarray
    bias: float
    chain: np.ndarray

    def logits(self, word: np.ndarray, first: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return sums_by_text(self.words[word], first) + self.bias + earlier @ self.chain


def fit(word: np.ndarray, first: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Ridge logistic regression on words scaled by their log ratio of document frequencies, by accelerated gradient steps."""
    n, positive = len(y), int(y.sum())
    share = (positive + 0.5) / (n + 1)
    if positive in (0, n):
        return Linear(np.zeros(CLASSES), float(np.log(share / (1 - share))) if n and positive else -30.0, np.zeros(earlier.shape[1]))
    row = np.repeat(np.arange(n), np.diff(first))
    with_it, without = np.bincount(word[y[row]], minlength=CLASSES), np.bincount(word[~y[row]], minlength=CLASSES)
    ratio = np.log((with_it + 1) / (positive + 2)) - np.log((without + 1) / (n - positive + 2))
    ratio[with_it + without < LEAST_DOCS] = 0
    used = np.flatnonzero(ratio)
    column = np.full(CLASSES, -1)
    column[used] = np.arange(len(used))
    keep = column[word] >= 0
    row, col, x = row[keep], column[word[keep]], ratio[word[keep]]
    size = np.sqrt(np.bincount(row, x * x, n)) + 1e-9
    scale = float(np.quantile(size, 0.5))
    x, z = x / scale, np.hstack([earlier / 4, np.ones((n, 1))])
    w, v, before = np.zeros(len(used)), np.zeros(z.shape[1]), None
    step = 4.0 / (1 + np.max(np.bincount(row, x * x, n).mean() + (z * z).sum(1).mean()))
    mw, mv = w.copy(), v.copy()
    for k in range(STEPS * 4):
        p = _sigmoid(np.bincount(row, x * mw[col], n) + z @ mv) - y
        weight = np.where(y, 0.5 / positive, 0.5 / (n - positive))
        gw = np.bincount(col, x * (p * weight)[row], len(used)) + RIDGE / n * mw
        gv = z.T @ (p * weight)
        nw, nv = mw - step * gw, mv - step * gv
        mw, mv = nw + k / (k + 3) * (nw - w), nv + k / (k + 3) * (nv - v)
        w, v = nw, nv
        if before is not None and k % 20 == 0 and abs(np.abs(gw).max(initial=0) - before) < 1e-7:
            break
        before = np.abs(gw).max(initial=0)
    words = np.zeros(CLASSES)
    words[used] = w * ratio[used] / scale
    return Linear(words, float(v[-1]), v[:-1] / 4)


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        logits = np.zeros((len(first) - 1, 0))
        for model in self.models:
            logits = np.hstack([logits, np.clip(model.logits(word, first, logits), -8, 8)[:, None]])
        return _sigmoid(logits)


def _rows(word: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)[pick]
    begin = np.concatenate(([0], np.cumsum(size)))
    return word[np.repeat(first[:-1][pick] - begin[:-1], size) + np.arange(begin[-1])], begin


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of the thresholds with the best F1, the middle between the scores on either side."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(y) else 0)) / 2)


def fit_chain(word: np.ndarray, first: np.ndarray, labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    n = len(first) - 1
    fold, out, models, cuts = np.arange(n) % folds, np.zeros((n, 0)), [], []
    for y in labels.values():
        held = np.zeros(n)
        for k in range(folds):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            model = fit(*_rows(word, first, train), out[train], y[train])
            held[test] = model.logits(*_rows(word, first, test), out[test])
        models.append(fit(word, first, out, y))
        cuts.append(_best_threshold(_sigmoid(np.clip(held, -8, 8)), y))
        out = np.hstack([out, np.clip(held, -8, 8)[:, None]])
    return Chain(list(labels), models, cuts)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Fits a chain on at most `sample` labelled documents. categories: conditions on the labels, in the order of the chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            word, first = features(block)
            held = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(word.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.rows.column(0), held, *(block.rows.column(2 + i) for i in range(len(names)))], ["doc_id", "word", *names])

    names = list(categories)
    known = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("_id")).agg(*(F.max(c).alias(n) for n, c in categories.items())).dropna()
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), rows["doc_id"] == known["_id"]).select("doc_id", "text", *names)
    # At most `sample` rows (times repeated documents, of which the first stays), each of at most CLASSES numbers.
    got = rows.mapInArrow(run, "doc_id long, word array<int>, " + ", ".join(f"{n} boolean" for n in names)).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    first = np.concatenate(([0], np.cumsum([len(x) for x in got["word"]]))).astype(np.int64)
    word = np.concatenate([np.zeros(0, np.int64), *got["word"]]).astype(np.int64)
    return fit_chain(word, first, {n: got[n].to_numpy(bool) for n in names})


def classify(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: p_<category> for each category of the chain, and the last category's verdict under its name."""
    sent, names = docs.sparkSession.sparkContext.broadcast(chain), [f"p_{c}" for c in chain.categories]
    verdict = chain.categories[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            p = sent.value.probabilities(*features(block))
            yield pa.RecordBatch.from_arrays([block.rows.column(0), *(pa.array(x) for x in p.T), pa.array(p[:, -1] >= sent.value.thresholds[-1])], ["doc_id", *names, verdict])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + f", {verdict} boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels have two categories, so the chain has: low quality, then toxic."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, train(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}))
