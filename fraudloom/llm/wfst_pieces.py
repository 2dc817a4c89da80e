"""SentencePiece encoding and decoding by weighted transducers (operator 10).

A model file is compiled into transducers over the tropical semiring:

* the normaliser rewrites the input: blanks become the mark U+2581 and one mark
  is put in front;
* the lexicon is the closure of a trie of all pieces; a character that no piece
  spells goes through byte fallback, one arc per UTF-8 byte;
* for a unigram model an arc weighs minus its piece's score. For a merge (BPE)
  model scores rank merges and their sum means nothing; there a third transducer
  with one state per piece weighs a pair of neighbours 0 if merging their joined
  text gives back just these two pieces, and infinity otherwise.

An input is composed with them lazily and the shortest path is taken. For merge
models exactly one path is finite, and it is what merging the whole text gives:
merges inside a pair of neighbours go in the same order whether the pair stands
alone or in a text, so a text's result has only compatible neighbours, and a
sequence of compatible neighbours never sees a merge across a boundary.

Composition stops between two characters that stand together in no piece (a
letter and a comma, say), so paths are found chunk by chunk and kept in a bounded
cache.

Defined results: null and empty texts give no pieces. Models with a character
map, user-defined pieces or white-space suffixes are refused, not approximated.
"""

from __future__ import annotations

import re
import struct
import weakref
import zlib
from collections.abc import Iterable, Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from fraudloom.llm.common import annotate, bound_batches, fresh, once_per_worker, sha256_hex, tokenizer_file

MARK = "▁"
#: Fixed values of the model file's format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterable[tuple[int, object]]:
    """Field numbers and raw values of a serialised protocol message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.add_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if normalizer.get(2) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("models with a character map, bare blanks or suffix marks are not supported")
        if USER_DEFINED in self.kinds:
            raise ValueError("user-defined pieces are not supported")


class _Words(dict):
    """Packed ids of chunks, mostly words. The older half is forgotten when full; very long chunks are never kept."""

    def __init__(self, owner: "Transducer"):
        super().__init__()
        # no cycle: a worker that drops the transducer has its memory back at once
        self.owner, self.old = weakref.proxy(owner), {}

    def __missing__(self, chunk: str) -> bytes:
        own = self.old.get(chunk)
        if own is None:
            own = self.owner.found(chunk)
        if len(chunk) <= Transducer.CACHED:
            if len(self) >= self.owner.WORDS:
                self.old = dict(self)
                self.clear()
            self[chunk] = own
        return own


def _slots(text: str) -> np.ndarray:
    """A 20-bit hash of each pair of neighbouring characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(12)


class Transducer:
    """The composed transducer of one model, with caches of paths and weights."""

    WORDS, PAIRS, CACHED = 60_000, 150_000, 64

    def __init__(self, data: bytes):
        self.model = m = Model(data)
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == NORMAL}
        self.unknown = m.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.fallback = m.byte_fallback and len(self.byte_ids) == 256
        self.rank = {p: m.scores[i] for p, i in self.ids.items()}
        self.spanned = np.zeros(1 << 20, bool)
        pairs = "".join(p[i : i + 2] for p in self.ids for i in range(len(p) - 1))
        self.spanned[_slots(pairs)[::2]] = True
        self.words = _Words(self)
        self.longest = max(map(len, self.ids), default=1)
        self.trie: dict = {}
        for piece in sorted(self.ids, key=len):
            node, arcs = self.trie, (piece[0],)
            for i, c in enumerate(piece, 1):
                node = node.setdefault(c, {})
                # pieces on the way to this node; shorter pieces are in the trie already
                arcs = node.setdefault("", (*arcs, piece) if 1 < i == len(piece) else arcs)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.held = 0
        self.packed: dict[str, bytes] = {p: struct.pack("<I", i) for p, i in self.ids.items()}
        self.unk_cost = (-min(m.scores) if m.scores else 0.0) + 10.0  # fixed value: penalty of an unknown character

    # the normaliser

    def normalise(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.model.add_prefix else "") + text.replace(" ", MARK)

    # the lexicon and byte fallback

    def arcs(self, chunk: str, at: int) -> tuple[str, ...]:
        """Pieces that leave position ``at``, longest last; a lone character where none spells it."""
        node = self.trie.get(chunk[at])
        if node is None:
            return (chunk[at],)
        for c in chunk[at + 1 : at + self.longest]:
            ahead = node.get(c)
            if ahead is None:
                break
            node = ahead
        return node[""]

    def emit(self, piece: str) -> list[int]:
        own = self.ids.get(piece)
        if own is not None:
            return [own]
        return [self.byte_ids[b] for b in piece.encode()] if self.fallback else [self.unknown]

    # weights

    def weight(self, piece: str) -> float:
        own = self.ids.get(piece)
        return self.unk_cost if own is None else -self.model.scores[own]

    def merged(self, text: str) -> list[str]:
        """Pieces that merging gives: always the best-ranked neighbours first, leftmost among equals."""
        parts, rank = list(text), self.rank.get
        found = [rank(x + y, -inf) for x, y in zip(parts, parts[1:])]
        while found:
            best = max(found)
            if best == -inf:
                break
            i = found.index(best)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i < len(found):
                found[i] = rank(parts[i] + parts[i + 1], -inf)
            if i:
                found[i - 1] = rank(parts[i - 1] + parts[i], -inf)
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether the pair weighs 0 rather than infinity."""
        known = self.pairs.get(a, {}).get(b)
        if known is None:
            if self.held >= self.PAIRS:
                for own in self.pairs.values():
                    own.clear()
                self.held = 0
            known = self.pairs.setdefault(a, {})[b] = self.merged(a + b) == [a, b]
            self.held += 1
        return known

    # the shortest path

    def path(self, chunk: str) -> list[str]:
        return self._merge_path(chunk) if self.model.kind == BPE else self._unigram_path(chunk)

    def _unigram_path(self, chunk: str) -> list[str]:
        best, back = [0.0] + [inf] * len(chunk), [""] * (len(chunk) + 1)
        for at in range(len(chunk)):
            for piece in self.arcs(chunk, at):
                cost, end = best[at] + self.weight(piece), at + len(piece)
                if cost < best[end]:
                    best[end], back[end] = cost, piece
        out, at = [], len(chunk)
        while at:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def _merge_path(self, chunk: str) -> list[str]:
        """The only finite path: longest arcs first, each state (position, last piece) left once."""
        path: list[str] = []
        untried: list[tuple[tuple[str, ...], int]] = []
        dead: set[tuple[int, str]] = set()
        at, last, arcs, known, end = 0, None, self.arcs(chunk, 0), {}, len(chunk)
        left = len(arcs)
        while True:
            while left:
                left -= 1
                piece = arcs[left]
                if last is not None:
                    fits = known.get(piece)
                    if not (self.fits(last, piece) if fits is None else fits):
                        continue
                if not dead or (at + len(piece), piece) not in dead:
                    break
            else:
                dead.add((at, last))
                at -= len(path.pop())
                (arcs, left), last = untried.pop(), path[-1] if path else None
                known = self.pairs.get(last, {})
                continue
            path.append(piece)
            at += len(piece)
            if at == end:
                return path
            untried.append((arcs, left))
            last, arcs, known = piece, self.arcs(chunk, at), self.pairs.get(piece, {})
            left = len(arcs)

    # whole texts

    def lone(self, piece: str) -> bytes:
        """Packed ids of one piece, or of a character that no piece spells."""
        return self.packed.get(piece) or np.asarray(self.emit(piece), "<u4").tobytes()

    def found(self, chunk: str) -> bytes:
        """Packed ids of some normalised text that no piece spans at its ends."""
        return b"".join(map(self.lone, self.path(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        whole = self.normalise(text)
        return b"".join(map(self.words.__getitem__, self._cut(whole))) if whole else b""

    def _cut(self, text: str) -> list[str]:
        """A normalised text cut where no piece can span; two pairs of characters may share a slot, which only spares a cut."""
        at = (np.flatnonzero(~self.spanned[_slots(text)]) + 1).tolist()
        return list(map(text.__getitem__, map(slice, [0, *at], [*at, len(text)])))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of some ids; broken byte sequences become U+FFFD and control pieces nothing."""
        out, held, kinds = [], bytearray(), self.model.kinds
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_lenient(bytes(held)))
                held.clear()
            if kinds[i] in (NORMAL, UNUSED):
                out.append(self.model.pieces[i])
            elif kinds[i] == UNKNOWN:
                out.append(" ⁇ ")  # fixed value: what an unknown piece reads as
        if held:
            out.append(_lenient(bytes(held)))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.model.add_prefix and text.startswith(" ") else text


def _lenient(data: bytes) -> str:
    return data.decode(errors="replace")


class _Decoder:
    """Vectorised decoding of long id arrays: pieces' bytes are joined, then read as UTF-8."""

    def __init__(self, m: Model):
        spelled = []
        for i, (p, k) in enumerate(zip(m.pieces, m.kinds)):
            if k == BYTE:
                spelled.append(bytes([int(p[3:5], 16)]))
            elif k in (NORMAL, UNUSED):
                spelled.append(p.replace(MARK, " ").encode())
            else:
                spelled.append(" ⁇ ".encode() if k == UNKNOWN else b"")
        self.spelled, self.prefix = spelled, m.add_prefix

    def __call__(self, ids: np.ndarray) -> bytes:
        data = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return data[1:] if self.prefix and data[:1] == b" " else data


def compiled(data: bytes) -> tuple[Transducer, _Decoder]:
    """The transducers of a model file's bytes; each worker compiles them once."""
    def make():
        t = Transducer(data)
        return t, _Decoder(t.model)

    return once_per_worker(("pieces", hash(data)), make)


def decoder(data: bytes) -> _Decoder:
    """The decoder of a model file's bytes alone; it takes the place of all else that the worker kept."""
    return once_per_worker(("decoder", hash(data)), lambda: _Decoder(Model(data)), 1)


def model_bytes(path: str | None = None) -> bytes:
    with open(path or tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column (n_pieces, n_byte_pieces, ids), whose name is returned too."""
    name = fresh(docs, "encoded")
    shared = docs.sparkSession.sparkContext.broadcast(model or model_bytes())

    def rows(texts: list[bytes]) -> Iterable[tuple]:
        t, _ = compiled(shared.value)
        low, high = _byte_range(t)
        for x in texts:
            ids = np.frombuffer(t.encode(x.decode()), "<u4")
            yield len(ids), int(((ids >= low) & (ids <= high)).sum()), ids.astype(np.int32)

    return annotate(docs, name, "n_pieces long, n_byte_pieces long, ids array<int>", rows, text), name


def decode_documents(docs: DataFrame, ids: str = "ids", model: bytes | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a column of the texts that an array column of piece ids spells, whose name is returned too; null is empty."""
    name, at = fresh(docs, "decoded"), docs.columns.index(ids)
    shared = docs.sparkSession.sparkContext.broadcast(model or model_bytes())
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(shared.value)
        for batch in batches:
            lists = batch.column(at)
            texts = [decode(np.asarray(lists[i].as_py() or [], "<u4")).decode() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())])), name


def encoded_digests(docs: DataFrame, model: bytes | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with what encoding and decoding give: counts, crc32 of the ids, sha-256 of the decoded text, round trip."""
    name = fresh(docs, "encoded")
    shared = docs.sparkSession.sparkContext.broadcast(model or model_bytes())

    def rows(texts: list[bytes]) -> Iterable[tuple]:
        t, decode = compiled(shared.value)
        t.WORDS, t.PAIRS = 200_000, 400_000  # no other stage's memory is held beside these caches
        low, high = _byte_range(t)
        for x in texts:
            data = t.encode(x.decode())
            ids = np.frombuffer(data, "<u4")
            back = decode(ids)
            yield len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(data), sha256_hex(back), back == x

    fields = "n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return annotate(docs, name, fields, rows, text), name


def _byte_range(t: Transducer) -> tuple[int, int]:
    """Ids of the byte pieces, which stand together; an empty range without them."""
    return (min(t.byte_of), max(t.byte_of)) if t.byte_of else (1, 0)
