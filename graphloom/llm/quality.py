"""Quality rules by repetition coverage.

Rolling hashes of n-grams of several lengths (numpy, a block of whole texts at a time) mark the words that
lie inside n-grams found twice or more; the rules compare the characters in those words, and in repeated
lines, with the characters of all words. Words and lines are equal if their bytes are. One pass, no shuffle, so a hot source or group of copies does not matter.

Null texts have no words and so fail; the longest text is held by one task in a few times its size. Repeated rows
and ids are judged one by one. Empty tables give empty results. Other columns are not read by ``quality_rules``
and are passed on by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm._text import BASE2, NON_SPACE, Block, blocks, classes, covered, mix, sums_by_text

#: Largest share, in per cent, of the characters of all words that may lie in repeated n-grams of n words.
NGRAM_LIMITS = {5: 40, 8: 30, 13: 25}
#: Largest share, in per cent, of the characters of all words that may lie in lines equal to an earlier line.
LINE_LIMIT = 30
#: Largest share, in per cent, of symbols against characters of words.
SYMBOL_LIMIT = 10
MIN_WORDS = 20
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS) + ", base_failed boolean, kept boolean"


def _repeats(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the entries whose (text, key) is found more than once, and of those with an equal earlier one."""
    order = np.lexsort((keys, text))
    same = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def _roll(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    base, m = BASE2, len(words) - n + 1
    value = np.zeros(max(m, 0), np.uint64)
    for i in range(n if m > 0 else 0):
        value = value * np.uint64(base) + words[i : i + m]
    return mix(value)


def measure(block: Block) -> dict[str, np.ndarray]:
    starts, ends, first = block.words(NON_SPACE)
    chars = np.concatenate(([0], np.cumsum((block.buf & 0xC0) != 0x80)))
    word_chars, text = chars[ends] - chars[starts], np.repeat(np.arange(len(block)), np.diff(first))
    out = {"n_words": np.diff(first), "word_chars": sums_by_text(word_chars, first), "n_symbols": sums_by_text(SYMBOLS[block.buf], block.first)}
    words = mix(classes(block.buf, starts, ends))
    inside = {}
    for n in sorted({8, *NGRAM_LIMITS}):
        grams = _roll(words, n)
        whole = np.flatnonzero(text[: len(grams)] == text[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
        twice, _ = _repeats(grams[whole], text[whole])
        inside[n] = covered(len(words), whole[twice], whole[twice] + n)
    out["n_repeat_words"] = sums_by_text(inside[8], first)
    for n in NGRAM_LIMITS:
        out[f"dup_chars_{n}"] = sums_by_text(inside[n] * word_chars, first)
    breaks = np.flatnonzero(block.buf == 10)
    begins = np.concatenate(([0], breaks[:-1] + 1))
    held = np.searchsorted(starts, breaks) - np.searchsorted(starts, begins)
    full = np.flatnonzero(held)
    where = block.text_of(begins[full])
    _, later = _repeats(classes(block.buf, begins[full], breaks[full]), where)
    out["n_dup_lines"] = np.bincount(where[later], minlength=len(block))
    before = np.concatenate(([0], np.cumsum(word_chars)))
    of_line = before[np.searchsorted(starts, breaks[full])] - before[np.searchsorted(starts, begins[full])]
    out["dup_line_chars"] = np.bincount(where[later], of_line[later], len(block)).astype(np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    kept = ~out["base_failed"] & (100 * out["dup_line_chars"] <= LINE_LIMIT * out["word_chars"]) & (100 * out["n_symbols"] <= SYMBOL_LIMIT * out["word_chars"])
    for n, limit in NGRAM_LIMITS.items():
        kept &= 100 * out[f"dup_chars_{n}"] <= limit * out["word_chars"]
    return out | {"kept": kept}


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: what the rules count, and their verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = measure(block)
            yield pa.RecordBatch.from_arrays([block.rows.column(0), *(pa.array(found[n]) for n in names[1:])], names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with all columns, that the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            yield block.rows.filter(pa.array(measure(block)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _gram_sql(n: int) -> str:
    gram = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER d" for i in range(1, n))])
    return f"""g{n} AS (SELECT doc_id, i, c, {gram} AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
t{n} AS (SELECT doc_id, i, c, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS twice FROM g{n}),
m{n} AS (SELECT doc_id, c, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM t{n}),
r{n} AS (SELECT doc_id, CAST(sum(hit) AS BIGINT) AS repeated, CAST(sum(hit * c) AS BIGINT) AS chars FROM m{n} GROUP BY doc_id)"""


ORACLE = rf"""
WITH words AS (SELECT doc_id, i, w[i] AS w, length(w[i]) AS c FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i)),
{", ".join(_gram_sql(n) for n in sorted({8, *NGRAM_LIMITS}))},
lines AS (SELECT doc_id, i, l[i] AS line, list_sum([length(x) for x in regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')]) AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)),
ranked AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM lines WHERE c > 0),
dup AS (SELECT doc_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars FROM ranked WHERE k > 1 GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS c FROM words GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(k.n, 0) AS n_words, coalesce(k.c, 0) AS word_chars, coalesce(len(regexp_extract_all(d.text, '[#*$%&|<>]')), 0) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(r8.repeated, 0) AS n_repeat_words, coalesce(dup.chars, 0) AS dup_line_chars, {", ".join(f"coalesce(r{n}.chars, 0) AS dup_chars_{n}" for n in NGRAM_LIMITS)}
 FROM documents d LEFT JOIN counts k USING (doc_id) LEFT JOIN dup USING (doc_id) {" ".join(f"LEFT JOIN r{n} USING (doc_id)" for n in sorted({8, *NGRAM_LIMITS}))}),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND 100 * n_symbols <= {SYMBOL_LIMIT} * word_chars {"".join(f" AND 100 * dup_chars_{n} <= {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())} AS kept FROM b"""
