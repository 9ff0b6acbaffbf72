"""Words of runs of Chinese characters, by a dictionary and, for what it lacks, a model of characters.

The lattice of a run is a join: each of its pieces, as long as the longest word at most, meets the dictionary by equality, so neither has to fit a task. The best path has the greatest
product of the words' shares of all counts (a character that is no word counts as one seen once); of equal paths that with the longer word first. Stretches of such characters are split by a model of
where in a word a character stands (begin, middle, end, single), fitted on the words that the dictionary has found in the same runs; its table has four counts a character and goes to all tasks.

Runs are distinct before they are cut up, and carry a number, not themselves, through the joins. A run is put together by one task."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.shared import cut, written
from graphloom.operators.traverse import FEW

RUN = "[\\u4e00-\\u9fa5]+"
TAGS = "BMES"
#: What may follow a place in a word.
NEXT = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


def cjk_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), 0)


def best_path(n: int, words: dict[tuple[int, int], float], total: float) -> list[int]:
    """The lengths of the words of a run of n characters; words: (start, length) to count."""
    least, at = -math.log(total), [[] for _ in range(n)]
    for (i, k), freq in words.items():
        at[i].append((k, math.log(freq) - math.log(total)))
    score, step = [0.0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        found = at[i] if any(k == 1 for k, _ in at[i]) else [(1, least), *at[i]]
        score[i], step[i] = max((w + score[i + k], k) for k, w in found)
    out, i = [], 0
    while i < n:
        out.append(step[i])
        i += step[i]
    return out


def split_unknown(text: str, chars: dict[tuple[str, str], int], moves: dict[tuple[str, str], int]) -> list[str]:
    """A stretch of unknown characters, by the most likely places (Viterbi, one added to each count)."""
    seen = {t: sum(n for (_, tag), n in chars.items() if tag == t) for t in TAGS}
    if not any(seen.values()):
        return list(text)
    kinds = len({c for c, _ in chars}) + 1
    emit = lambda c, t: math.log((chars.get((c, t), 0) + 1) / (seen[t] + kinds))
    move = {(a, b): math.log((moves.get((a, b), 0) + 1) / (sum(moves.get((a, x), 0) for x in NEXT[a]) + 2)) for a in TAGS for b in NEXT[a]}
    best = {t: (emit(text[0], t), t) for t in "BS"}
    for c in text[1:]:
        best = {t: max((best[a][0] + move[a, t] + emit(c, t), best[a][1] + t) for a in best if t in NEXT[a]) for t in TAGS if any(t in NEXT[a] for a in best)}
    tags = max(best[t] for t in "ES" if t in best)[1]
    out, begin = [], 0
    for i, t in enumerate(tags):
        if t in "ES":
            out.append(text[begin : i + 1])
            begin = i + 1
    return out


def _known(row: dict, total: float) -> list[tuple[str, bool]]:
    """The words of the best path, and whether the dictionary has them."""
    words = {(w["i"], w["k"]): w["freq"] for w in row["w"] or ()}
    out, i = [], 0
    for k in best_path(len(row["run"]), words, total):
        out.append((row["run"][i : i + k], (i, k) in words))
        i += k
    return out


def _lattices(runs: DataFrame, words: DataFrame) -> tuple[DataFrame, float]:
    """id, run, w: of distinct runs, the dictionary's words inside (i, k, freq); and the sum of all counts."""
    runs = cut(runs.select("run").where("run <> ''").distinct().withColumn("id", F.monotonically_increasing_id()))
    words = cut(words.where("word <> '' AND freq > 0").groupBy("word").agg(F.sum("freq").cast("double").alias("freq")))
    n, longest, total = words.agg(F.count("*"), F.max(F.length("word")), F.sum("freq")).first()
    if not n:
        return runs.select("id", "run", F.array().cast("array<struct<i:int,k:int,freq:double>>").alias("w")), 1.0
    size = F.length("run")
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i)), lambda k: F.struct(i.alias("i"), k.alias("k"), F.substr("run", i + 1, k).alias("word")))))
    met = runs.select("id", F.inline(pieces)).join(F.broadcast(words) if n <= FEW else words, "word")
    held = met.groupBy("id").agg(F.collect_list(F.struct("i", "k", "freq")).alias("w"))
    return runs.join(held, "id", "left").select("id", "run", "w"), float(total)


def segment(runs: DataFrame, words: DataFrame) -> DataFrame:
    """runs: run; words: word, freq. run, words (in order), found (the words as a search engine wants them: before a word of more than two characters the dictionary's words of two and three inside it)."""
    lattices, total = _lattices(runs, words)
    lattices = written(lattices, "lattices")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                before = None
                for word, known in _known(row, total):
                    tags = "S" if len(word) == 1 else "B" + "M" * (len(word) - 2) + "E"
                    if known:
                        seen.update(zip(word, tags, strict=True))
                        seen.update(zip((before or "") + tags, ((before or "") + tags)[1:], strict=False))
                    before = tags[-1] if known else None
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen]), pa.array([b for _, b in seen]), pa.array(list(seen.values()), pa.int64())], ["a", "b", "n"])

    # Four rows a character at most.
    counts = {(r.a, r.b): r.n for r in lattices.mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    chars, moves = ({k: n for k, n in counts.items() if (k[0] in TAGS) == tag} for tag in (False, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = [], []
            for row in batch.to_pylist():
                path, odd = [], ""
                for word, known in [*_known(row, total), ("", True)]:
                    if known:
                        path += split_unknown(odd, chars, moves) if odd else []
                        path, odd = path + [word] * bool(word), ""
                    else:
                        odd += word
                inside, at, told = {(w["i"], w["k"]) for w in row["w"] or ()}, 0, []
                for word in path:
                    told += [row["run"][i : i + k] for k in (2, 3) if len(word) > k for i in range(at, at + len(word) - k + 1) if (i, k) in inside]
                    told.append(word)
                    at += len(word)
                paths.append(path)
                found.append(told)
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("run")), pa.array(paths, kind), pa.array(found, kind)], ["run", "words", "found"])

    return lattices.mapInArrow(run, "run string, words array<string>, found array<string>")


def cjk_tokens(docs: DataFrame, words: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, term: the words of all Chinese runs, as often as they occur."""
    runs = docs.select(F.col(doc).alias("doc"), F.explode(cjk_runs(F.col(text))).alias("run"))
    told = segment(runs, words)
    return runs.join(told, "run").select("doc", F.explode("found").alias("term"))
