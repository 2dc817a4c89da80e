"""Token ids in bit-packed files (operator 7).

Texts are encoded with a public tokenizer, a final id is put behind each, and the
ids are written in ascending doc_id order, each in the fewest bits that the
vocabulary needs.

The format is a Parquet table of blocks, so that Spark's committers and readers
take care of lost executors and of any file system. A block holds whole
documents: shard and block number, the place of its first id in the shard, the
number of ids, the packed ids, and its documents' ids and ends. Ids lie at
multiples of the bit width, so any range of a block unpacks with numpy alone;
shards are ranges of doc_id, and a shard's first place is the sum of those before.

Byte-level tokenizers split texts before merging, always in front of a single
blank or line end between other characters; such pieces are encoded by the
tokenizers library once and kept in a bounded cache. Other texts go to the
library whole.

Defined results: null and empty texts have the final id alone; equal doc_ids are
ordered by their texts' bytes, null ids come first; strings of added tokens become
those tokens, as in the library's plain call; an empty table makes no blocks.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.llm.common import bound_batches, once_per_worker, tokenizer_file
from fraudloom.session import shared_folder

BLOCK_IDS = 65_536
SHARD_BYTES = 64 << 20
BLOCKS = "shard int, block int, first long, n long, bits int, payload binary, doc_ids array<long>, ends array<long>"
#: White space that is not a lone blank or line end between two other characters, and the mark that cuts texts.
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_ODD_ASCII = ("\0", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_ODD_SPACE = re.compile(r"[^\S\x00-\x20]")


def id_bits(vocabulary: int) -> int:
    return max((vocabulary - 1).bit_length(), 1)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(places.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` on, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype("<u4")
    first, end = start * bits // 8, -(-(start + count) * bits // 8)
    places = np.unpackbits(np.frombuffer(payload, np.uint8, end - first, first), bitorder="little")
    skip = start * bits - first * 8
    places = places[skip : skip + count * bits].reshape(count, bits)
    return (places.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class _Words(dict):
    """Ids of words with the blank, or the line end, in front of them; made when first asked for.

    When full, the older half is set aside and used once more.
    """

    KEPT, LONGEST = 350_000, 64

    def __init__(self, owner: "Encoder"):
        super().__init__()
        self.owner, self.old, self.marks = owner, {}, {}

    def __missing__(self, word: str) -> bytes:
        own = self.old.get(word)
        if own is None:
            owner = self.owner
            stem = word.rstrip(owner.MARKS)
            if stem and len(stem) < len(word) and stem[-1].isalnum() and stem[-1] < owner.PLAIN:
                # letters or digits and the marks behind them are apart, whatever comes before
                run = word[len(stem) :]
                own = self.marks.get(run)
                if own is None:
                    own = self.marks[run] = owner.spelled(run)
                own = self[stem] + own
            else:
                own = owner.word(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.old = dict(self)
                self.clear()
                self.marks.clear()
            self[word] = own
        return own


class Encoder:
    """A tokenizer with a cache of words between blanks.

    Words that are one run of letters or ASCII digits, with or without marks behind,
    go straight to the library's merge model; below U+0250 there is no doubt what a
    letter is. Other words are encoded by the library, each once.
    """

    MARKS, PLAIN = ",.;:!?|#*&%$", "\u0250"

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.packed = [struct.pack("<I", i) for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        kind, line = self.tokenizer.pre_tokenizer, self._library("\n")
        plain = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and kind.use_regex
        self.added = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.splits = plain and self.tokenizer.normalizer is None and len(line) == 4 and not any("\n" in x for x in self.added)
        self.line = line
        self.known = _Words(self)

    def _library(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.asarray(found.ids, "<u4").tobytes()

    def spelled(self, piece: str) -> bytes:
        """Ids of a piece that is not split before merging."""
        if piece.isascii():  # visible ASCII stands for itself
            spelled = piece.replace(" ", self.letters[0x20])
        else:
            spelled = "".join(map(self.letters.__getitem__, piece.encode()))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(spelled)])

    def bare(self, word: str) -> bytes:
        """Ids of a word as it stands, without white space inside."""
        ascii_ = word.isascii()
        if word.isalpha() and (ascii_ or max(word) < self.PLAIN) or ascii_ and word.isdigit():
            return self.spelled(word)
        return self._library(word)

    def word(self, word: str) -> bytes:
        """Ids of a blank and a word, or of a line end, which is a token of its own, and a word."""
        if word[:1] == "\n":
            return self.line + self.bare(word[1:]) if len(word) > 1 else self.line
        ascii_ = word.isascii()
        if word.isalpha() and (ascii_ or max(word) < self.PLAIN) or ascii_ and word.isdigit():
            return self.spelled(" " + word)
        return self._library(" " + word)

    def _splittable(self, text: str) -> bool:
        """Whether white space is only lone blanks and line ends between other characters, and no added token is spelled."""
        if any(x in text for x in self.added):
            return False
        if any(x in text for x in _DOUBLE) or text[0].isspace() or text[-1].isspace() or any(x in text for x in _ODD_ASCII):
            return False
        return text.isascii() or not _ODD_SPACE.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found, known = [], self.known.__getitem__
        for t in texts:
            if not t:
                found.append(b"")
            elif not self.splits or not self._splittable(t):
                found.append(self._library(t))
            else:  # a blank goes with the word behind it, a line end too
                words = t.replace("\n", " \n").split(" ")
                found.append(self.bare(words[0]) + b"".join(map(known, words[1:])))
        return found


def encoder(data: bytes) -> Encoder:
    """One encoder per worker and tokenizer."""
    return once_per_worker(("encoder", hash(data)), lambda: Encoder(data))


def _blocks(shared, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        bits = id_bits(max(own.vocabulary, end_id + 1))
        last = np.asarray([end_id], "<u4").tobytes()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        docs: list[int | None] = []
        ends: list[int] = []
        n = 0

        def made() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                pa.array([bits], pa.int32()), pa.array([pack(ids, bits)], pa.binary()),
                pa.array([docs], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
            ], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 64):
                for doc, ids in zip(names[at : at + 64], own.encode(texts[at : at + 64])):
                    held += (ids, last)
                    n += len(ids) // 4 + 1
                    docs.append(doc)
                    ends.append(n)
                    if n >= block_ids:
                        yield made()
                        held, docs, ends = [], [], []
                        block, first, n = block + 1, first + n, 0
        if docs:
            yield made()

    return run


def write_ids(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS,
    doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Encode all texts and write the packed blocks to ``path``."""
    spark = docs.sparkSession
    with open(tokenizer or tokenizer_file("byte_bpe_50k.json"), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    bound_batches(spark)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-total // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = slim.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.col("text").cast("binary"))
    ranged.mapInArrow(_blocks(shared, end_id, block_ids), BLOCKS).write.parquet(path)


def shard_places(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base): the place of each shard's first id in the whole. One row per shard visits the driver."""
    totals = sorted(spark.read.parquet(path).groupBy("shard").agg(F.sum("n").alias("n")).collect())
    rows, base = [], 0
    for shard, n in totals:
        rows.append((shard, base))
        base += n
    return spark.createDataFrame(rows, "shard int, base long")


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, first, n, bits, payload, docs, ends = (batch.column(i)[row].as_py() for i in range(7))
                ids, ends = unpack(payload, bits, 0, n), np.asarray(ends, np.int64)
                begins = np.append(0, ends[:-1])
                parts = [ids[a:b] for a, b in zip(begins, ends)]
                columns = [
                    pa.array(docs, pa.int64()), pa.array(base + first + begins, pa.int64()), pa.array(ends - begins, pa.int64()),
                    pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    placed = spark.read.schema(BLOCKS).parquet(path).join(F.broadcast(shard_places(spark, path)), "shard")
    return placed.select("base", "first", "n", "bits", "payload", "doc_ids", "ends").mapInArrow(run, fields)


def ids_between(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Random access: ``count`` ids from place ``start`` of the whole. Reads only the blocks that hold them."""
    placed = spark.read.schema(BLOCKS).parquet(path).join(F.broadcast(shard_places(spark, path)), "shard")
    at = F.col("base") + F.col("first")
    rows = placed.filter((at < start + count) & (at + F.col("n") > start)).select(at.alias("at"), "n", "bits", "payload").sort("at").collect()
    parts = []
    for r in rows:
        lo, hi = max(start - r["at"], 0), min(start + count - r["at"], r["n"])
        parts.append(unpack(bytes(r["payload"]), r["bits"], lo, hi - lo))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def encoded_digests(docs: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """Write the files, by default in the shared folder, and read every document back from them."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/packed/{uuid.uuid4().hex}"
    write_ids(docs, path, **settings)
    return read_documents(spark, path, with_ids=False)
