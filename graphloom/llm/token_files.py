"""Token ids in binary shards with Elias-Fano encoded document boundaries.

Documents are dealt by ranges of doc_id, encoded and written in that order: each task writes shards of at most
``SHARD_IDS`` ids (a longer document is a shard of its own). A shard is

    magic "GLTK1\\0\\0\\0" | 4 little-endian uint64: documents, ids, bytes an id, documents without a doc_id (they come first)
    ids, concatenated | boundaries (documents + 1 offsets from 0) | doc_ids less their minimum, and that minimum

where boundaries and doc_ids, which never descend, are Elias-Fano sequences: low bits packed, high parts in unary, and
every 64th one-bit's position sampled, so that ``select(i)`` reads a few bytes. No 64-bit table of offsets is kept.

A task writes to a name of its own attempt and reports the name with its rows; readers take only reported
names, so retried and speculative tasks leave nothing that is read. Shards are read by Spark's binaryFile
source, wherever they are; they are written through pyarrow's file systems.

Null and empty texts are the end id alone; rows without a doc_id come first; rows with one doc_id follow one another, ordered by
text; empty tables write no shard and give no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import TYPE_CHECKING

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import cut, new_folder, partitions
from graphloom.llm._text import as_bytes

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END_ID = 1
SHARD_IDS = 1 << 22
SAMPLE = 64
#: Documents of a shard that are returned at once.
ROWS = 4096
#: More shards than these are joined with their contents instead of sent to all tasks.
FEW_SHARDS = 100_000
#: White-space-separated pieces whose ids a worker remembers, before those not seen since the last as many go.
CACHE_PIECES = 300_000
#: Words that go through the library in one string.
JOINED = 64
MAGIC = b"GLTK1\0\0\0"
TOKENIZER = "word_bpe_49k.json"


class EliasFano:
    """A sequence of integers that never descend, from 0 upwards."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint64))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        return (int.from_bytes(self.low[a // 8 : (a + self.low_bits) // 8 + 1], "little") >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one-bit, the high part is counted forward byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, word = at // 8, self.high[at // 8] & (0xFF << at % 8)
        while (here := word.bit_count()) <= left:
            left, byte = left - here, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return ((8 * byte + (word & -word).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """The whole sequence as a table, for tests."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")) - np.arange(self.n)
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high << self.low_bits) + (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def dump(self) -> bytes:
        return struct.pack("<5Q", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def load(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, bits, low, high, samples = struct.unpack_from("<5Q", data)
        a, b, c = 40 + low, 40 + low + high, 40 + low + high + 8 * samples
        return cls(n, bits, bytes(data[40:a]), bytes(data[a:b]), np.frombuffer(data[b:c], np.uint64)), data[c:]


class Shard:
    """A shard as read; document(i) and doc_id(i) find theirs by the select structures."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.docs, self.size, width, self.nulls = struct.unpack_from("<4Q", data, 8)
        view = memoryview(data)[40:]
        self.ids = np.frombuffer(view[: self.size * width], f"<u{width}")
        self.bounds, view = EliasFano.load(view[self.size * width :])
        self.names, view = EliasFano.load(view)
        self.least = struct.unpack_from("<q", view)[0]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.names.select(i - self.nulls) + self.least

    def doc_ids(self) -> list[int | None]:
        return [self.doc_id(i) for i in range(self.docs)]

    @staticmethod
    def dump(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
        known = np.array([x for x in doc_ids if x is not None], np.int64)
        ids = np.concatenate(documents)
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        least = int(known[0]) if len(known) else 0
        bounds = EliasFano.of(np.concatenate(([0], np.cumsum([len(d) for d in documents]))))
        return MAGIC + struct.pack("<4Q", len(documents), len(ids), width, len(doc_ids) - len(known)) + ids.astype(f"<u{width}").tobytes() + bounds.dump() + EliasFano.of(known - least).dump() + struct.pack("<q", least)


LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Of pieces of printable ASCII without an apostrophe, these are what the tokenizer parts them into.
PRINTABLE = re.compile(rb"[!-&(-~]+")
RUNS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
#: A full stop or comma that ends any other piece and follows an ASCII letter is a token of its own.
STOP = re.compile(rb".*[a-z][.,]", re.DOTALL)


@cache
def plan_of(path: str) -> tuple[bool, np.ndarray]:
    """Whether texts may be encoded by pieces, and which ids end a word."""
    plan = json.loads(Path(path).read_bytes())
    suffix, vocab = plan["model"].get("end_of_word_suffix"), plan["model"]["vocab"]
    steps = [x for k, many in (("pre_tokenizer", "pretokenizers"), ("normalizer", "normalizers")) for x in (plan[k] or {}).get(many, [])]
    by_piece = bool(suffix) and {"type": "Lowercase"} in steps and any(x["type"] == "Split" and x.get("invert") and x["behavior"] == "Removed" for x in steps)
    ends = np.zeros(max([0, *vocab.values()]) + 1 if by_piece else 0, bool)
    if by_piece:
        ends[[i for word, i in vocab.items() if word.endswith(suffix)]] = True
    return by_piece, ends


@cache
def libraries(path: str) -> tuple[Tokenizer, Tokenizer]:
    """The tokenizer, read once a worker, and its model with white space as the only rule."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    words = Tokenizer(whole.model)
    words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return whole, words


class Encoder:
    """Ids of whole texts, as uint32.

    A tokenizer that drops white space never joins what white space parts, and this one lower-cases: a text's ids are those of its
    lower-cased pieces between ASCII white space, and a piece goes through the library once as long as it is remembered. A piece that ends
    in a full stop or comma after a letter has the ids of what is before, then those of the stop, one of printable ASCII those of its letters, digits and signs. Many
    pieces that are plain words (Latin letters only, so that each is one word to the tokenizer) go through it in one string, and the ids that end
    a word tell them apart; those of a-z only, which normalizing does not change, go through the same model with white space as the only rule. Texts that may hold special tokens, and all texts for tokenizers of another kind, go through it whole."""

    def __init__(self, path: str):
        self.tokenizer, self.words = libraries(path)
        self.by_piece, self.ends = plan_of(path)
        self.young, self.old = {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes], texts: list[str], tokenizer: Tokenizer) -> None:
        """Learns pieces, of one word each, as strings of many."""
        strings = [" ".join(texts[k : k + JOINED]) for k in range(0, len(texts), JOINED)]
        for e, at in zip(tokenizer.encode_batch_fast(strings, add_special_tokens=False), range(0, len(texts), JOINED), strict=True):
            ids = np.array(e.ids, "<u4")
            data, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            self.young.update(zip(pieces[at : at + JOINED], [data[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)], strict=True))

    def _learn(self, new: set[bytes]) -> None:
        words = [p for p in new if p.isalpha()]  # of bytes, a-z only
        new.difference_update(words)
        parted = {p: x for p in new if PRINTABLE.fullmatch(p) and len(x := RUNS.findall(p)) > 1}
        new.difference_update(parted)
        parted.update((p, (p[:-1], p[-1:])) for p in [p for p in new if STOP.fullmatch(p)])
        more = set().union(*parted.values()).difference(self.young, words)
        words += [p for p in more if p.isalpha()]
        new.update(more)
        new.difference_update(parted, words)
        self._joined(words, b" ".join(words).decode().split(), self.words)
        others = list(new)
        texts = [p.decode("utf-8", "replace") for p in others]
        plain = [x.isalpha() and max(x) < "\u0250" and "\u0130" not in x for x in texts]
        rest = [i for i, x in enumerate(plain) if not x]
        self.young.update(zip((others[i] for i in rest), self._whole([texts[i] for i in rest]), strict=True))
        latin = [i for i, x in enumerate(plain) if x]
        self._joined([others[i] for i in latin], [texts[i] for i in latin], self.tokenizer)
        get = self.young.__getitem__
        self.young.update((p, b"".join(map(get, x))) for p, x in parted.items())

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        end = np.array([END_ID], "<u4").tobytes()
        plain = [self.by_piece and b"<|" not in t for t in texts]
        whole = iter(self._whole([t.decode("utf-8", "replace") for t, p in zip(texts, plain, strict=True) if not p]))
        pieces = [t.translate(LOWER_ASCII).split() if p else None for t, p in zip(texts, plain, strict=True)]
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        new = set().union(*(x for x in pieces if x)).difference(self.young)
        again = [p for p in new if p in self.old]
        self.young.update((p, self.old[p]) for p in again)
        self._learn(new.difference(again))
        get = self.young.__getitem__
        return [np.frombuffer((next(whole) if x is None else b"".join(map(get, x))) + end, "<u4") for x in pieces]


MANIFEST = "part int, number int, name string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards and returns their manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, documents, size = [], [], 0

        def close() -> pa.RecordBatch:
            store, root = pyarrow.fs.FileSystem.from_uri(folder)
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.tok"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(Shard.dump(names, documents))
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "name": name, "n_docs": len(names), "n_ids": size}], schema)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                for name, ids in zip(rows.column(0).to_pylist(), encoder.encode(as_bytes(rows.column(1))), strict=True):
                    if names and size + len(ids) > shard_ids:
                        yield close()
                        number, names, documents, size = number + 1, [], [], 0
                    names.append(name)
                    documents.append(ids.astype("<u2") if ids.max() < 1 << 16 else ids)
                    size += len(ids)
        if names:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(dealt.mapInArrow(run, MANIFEST))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row a document, from the shards that the manifest names. `start` counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_py())
                for low in range(0, shard.docs, ROWS):
                    at = range(low, min(low + ROWS, shard.docs))
                    edges = [shard.bounds.select(i) for i in [*at, at.stop]]
                    sums = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    starts = np.array(edges, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([shard.doc_id(i) for i in at], pa.int64()), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a shard of millions of ids; the shards of a task are summed first.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("within", within).join(parts.select("part", "before"), "part").select("name", (F.col("before") + F.col("within")).alias("base"))
    if not manifest.limit(1).count():
        return spark.createDataFrame([], READ)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    # The contents stay where they are read as long as the manifest is small.
    placed = F.broadcast(placed) if manifest.count() <= FEW_SHARDS else placed
    return files.join(placed, "name").select("base", "content").mapInArrow(run, READ)


def token_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    folder = new_folder(docs.sparkSession, "tokens")
    manifest = write_shards(docs, folder, tokenizer or public_tokenizers.path(TOKENIZER), doc_id, text)
    return read_shards(docs.sparkSession, folder, manifest)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
