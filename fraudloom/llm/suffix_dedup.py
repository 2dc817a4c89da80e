"""Removal of repeated byte strings with suffix arrays (operator 1).

A byte goes if it lies in a string of ``length`` bytes that also starts earlier:
in a document with a smaller doc_id, or earlier in the same one.

One suffix array of the whole corpus fits no machine, so equal strings are first
brought together. The ``length - gram + 1`` grams in a string have a smallest
hash; that gram is the string's anchor, and equal strings have equal anchors at
the same place. Consecutive starts share an anchor, so a text falls into runs of
starts, each with its segment: the bytes that its strings cover.

1. Documents are dealt into groups of bounded bytes by their id's hash. A group
   sends each anchor hash once, with its count.
2. Hashes seen at least twice go back to the groups that sent them.
3. Groups send the segments of those anchors, equal segments once; later copies
   in a group are known to be repeats.
4. Segments of equal hashes meet. Equal segments fold into the earliest. Over the
   distinct ones a suffix array is built by two-stage sorting: suffixes smaller
   than their successors are sorted directly, the others are induced by scanning
   the buckets, and adjacent common prefixes give the groups of equal strings. All
   but the earliest start of each group are repeats.
5. Repeats go back to the documents' groups, which cut them out.

No step gathers a key's occurrences: a hash travels once per group, and so does a
segment. Anchors with more than ``hot`` occurrences are dealt out string by
string, by each string's own hash, so that their segments do not meet in one
task. Segments are sorted in batches of bounded bytes. Texts cross the network
once: all steps read the same exchange.

Defined results: null and empty texts have no bytes; rows with equal ids follow
each other in byte order of their texts; a null id comes before all others; texts
shorter than ``length`` lose nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.common import bytes_of

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # fixed value: any odd number does
_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK = 1 << 18
_PLACE = _U(20)


@dataclass(frozen=True)
class Spec:
    length: int = 100
    gram: int = 32
    #: Bytes of text that a group of documents has on average.
    group_bytes: int = 16 << 20
    #: Occurrences beyond which an anchor's strings are dealt out one by one.
    hot: int = 20_000
    #: Bytes of segments sorted together.
    batch_bytes: int = 2 << 20


# -- suffix arrays -----------------------------------------------------------------


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the end is smaller than any symbol."""
    n = len(t)
    smaller = np.zeros(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[1:] != t[:-1])
        # a run of equal symbols takes the type of its last place
        at = np.searchsorted(differs, np.arange(n - 1))
        known = at < len(differs)
        place = differs[np.minimum(at, len(differs) - 1)] if len(differs) else np.zeros(n - 1, np.int64)
        smaller[:-1] = known & (t[place] < t[np.minimum(place + 1, n - 1)])
    return smaller


def _words(t: np.ndarray) -> tuple[np.ndarray, int, int]:
    """At each place the next symbols plus one as one number, with zeros beyond the end; their count and bits."""
    bits = 9 if not len(t) or int(t.max()) < 511 else 16
    count = 63 // bits
    wide = np.zeros(len(t) + count, np.uint64)
    wide[: len(t)] = t.astype(np.uint64) + _U(1)
    out = np.zeros(len(t), np.uint64)
    for i in range(count):
        out = (out << _U(bits)) | wide[i : len(t) + i]
    return out, count, bits


def _sort_directly(starts: np.ndarray, packed: tuple[np.ndarray, int, int], most: int) -> np.ndarray:
    """Suffixes in the order of their first ``most`` symbols, some symbols at a time; only ties are looked at again."""
    words, step, _ = packed
    order = starts[np.argsort(words[starts], kind="stable")]
    first = words[order]
    head = np.ones(len(order), bool)
    head[1:] = first[1:] != first[:-1]
    depth, n = step, len(words)
    group = np.cumsum(head)
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(tied) and depth < most:
        at = order[tied] + depth
        key = np.where(at < n, words[np.minimum(at, n - 1)], _U(0))
        own = group[tied]
        by = np.lexsort((key, own))
        order[tied] = order[tied][by]
        key, own = key[by], own[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        # a group is named by the place of its first member, so names rise with the order
        group[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        depth += step
    return order


def suffix_array(
    t: np.ndarray, most: int | None = None, smaller: np.ndarray | None = None, wanted: np.ndarray | None = None
) -> np.ndarray:
    """Two-stage sorting of the suffixes of an array of symbols below 65,535.

    With ``most``, suffixes that agree in so many symbols may stand in any order.
    ``wanted`` marks the places to sort, all by default; with a place whose suffix
    is larger than its successor it must mark the next place too. ``smaller`` are
    the suffix types, if they are known.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    t = t.astype(np.int64)
    smaller = suffix_types(t) if smaller is None else smaller
    wanted = np.ones(n, bool) if wanted is None else wanted
    direct = _sort_directly(np.flatnonzero(smaller & wanted), _words(t), n if most is None else most)
    top = int(t.max()) + 1
    bounds = np.searchsorted(t[direct], np.arange(top + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(top)]
    if wanted[-1]:
        induced[t[-1]].append(np.array([n - 1], np.int64))  # the end comes first of all and induces the last suffix
    out = []
    for c in range(top):
        own = induced[c]
        wave = np.concatenate(own) if own else np.zeros(0, np.int64)
        parts = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & wanted[before]]
            parts.append(wave)
        bucket = np.concatenate([*parts, direct[bounds[c] : bounds[c + 1]]])
        induced[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        symbol = t[before]
        larger = (symbol > c) & wanted[before]
        before, symbol = before[larger], symbol[larger]
        if len(before):
            by = np.argsort(symbol.astype(np.uint16), kind="stable")
            before, symbol = before[by], symbol[by]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            for part, s in zip(np.split(before, cuts), symbol[np.append(0, cuts)]):
                induced[s].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def adjacent_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, ``most`` at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    (words, step, bits), n = _words(t), len(t)
    live, a, b, depth = np.arange(1, len(order)), order[:-1].copy(), order[1:].copy(), 0
    while len(live) and depth < most:
        inside = (a + depth < n) & (b + depth < n)
        live, a, b = live[inside], a[inside], b[inside]
        x = words[a + depth] ^ words[b + depth]
        same = np.full(len(x), step)
        differs = np.flatnonzero(x)
        # leading equal symbols of words that differ
        same[differs] = sum((x[differs] >> _U(bits * (step - 1 - i)) == 0).astype(np.int64) for i in range(step))
        left = n - np.maximum(a, b) - depth  # zeros beyond an end are equal too, but no symbols
        out[live] += np.minimum(same, left)
        go = (same == step) & (left > step)
        live, a, b = live[go], a[go], b[go]
        depth += step
    return np.minimum(out, most)


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, its starts whose string also starts in an earlier segment or earlier in it."""
    sizes = np.array([len(s) for s in segments], np.int64)
    places = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = np.zeros(places[-1], np.uint16)
    at = np.arange(len(t) - len(segments)) + np.repeat(np.arange(len(segments)), sizes)
    t[at] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    # only starts with a whole string before the separator are wanted, and what induces them:
    # the places up to the first suffix that is sorted directly
    begin, last = places[:-1], places[:-1] + sizes - length
    smaller = suffix_types(t)
    sorted_first = np.append(np.flatnonzero(smaller), len(t) - 1)
    stop = sorted_first[np.searchsorted(sorted_first, last)]
    wanted, starts = _ranges(begin, stop, len(t)), _ranges(begin, last, len(t))
    order = suffix_array(t, length, smaller, wanted)
    order = order[starts[order]]
    same = adjacent_prefixes(t, order, length) >= length
    group = np.cumsum(~same)
    many = np.flatnonzero(np.bincount(group)[group] > 1) if len(order) else np.zeros(0, int)
    g, p = group[many], order[many]
    by = np.lexsort((p, g))
    g, p = g[by], p[by]
    later = np.sort(p[1:][g[1:] == g[:-1]])
    cuts = np.searchsorted(later, places)
    return [later[cuts[i] : cuts[i + 1]] - places[i] for i in range(len(segments))]


def _ranges(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """True from each first to its last place, both included; ranges may meet but not overlap."""
    edges = np.zeros(n + 1, np.int64)
    some = last >= first
    np.add.at(edges, first[some], 1)
    np.add.at(edges, last[some] + 1, -1)
    return np.cumsum(edges[:-1]) > 0


# -- anchors -----------------------------------------------------------------------


def _powers() -> tuple[np.ndarray, np.ndarray]:
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(_CHUNK + 1024, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))  # wraps at 64 bits
    return made[0], made[1]


_POWERS: list = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes."""
    if not _POWERS:
        _POWERS.extend(_powers())
    up, down = _POWERS
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def anchor_runs(text: bytes, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with a common anchor: first starts, last starts and anchor hashes.

    Texts are read in chunks that overlap by a string less one byte, so the runs
    do not depend on the chunks, save that a run may be cut in two at a border.
    """
    data, width = np.frombuffer(text, np.uint8), spec.length - spec.gram + 1
    found = []
    for at in range(0, max(len(data) - spec.length + 1, 0), _CHUNK):
        part = data[at : at + _CHUNK + spec.length - 1]
        h = gram_hashes(part, spec.gram)
        least = ((h >> _PLACE) << _PLACE) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = least & _U((1 << 20) - 1)
        lo = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        hi = np.append(lo[1:] - 1, len(place) - 1)
        # the least hashes are small numbers; mixed again they spread over all slots
        found.append((lo + at, hi + at, _mix(h[place[lo].astype(np.int64)] + _U(_BASE))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


# -- the distributed steps -----------------------------------------------------------


def _rows(table: pa.Table) -> list[tuple[int | None, bytes]]:
    """A group's documents (id, text) in order."""
    made = zip(table["doc_id"].to_pylist(), bytes_of(table["text"].combine_chunks()))
    return sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    """The range of hashes that a hash falls in; rising with the hash."""
    return ((keys >> _U(32)) * _U(slots)) >> _U(32)


def _send_hashes(spec: Spec, slots: int):
    def run(key, table):
        hashes = [anchor_runs(t, spec)[2] for _, t in _rows(table)]
        values, counts = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, int))
        slot = _slot(values, slots).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
        counts = np.minimum(counts, 2**32 - 1).astype("<u4")
        parts = list(zip(cuts[:-1], cuts[1:]))
        return pa.table({
            "slot": pa.array([slot[a] for a, _ in parts], pa.int64()),
            "pid": pa.array([key[0].as_py()] * len(parts), pa.int64()),
            "hashes": pa.array([values[a:b].tobytes() for a, b in parts], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in parts], pa.binary()),
        })

    return run


def _repeated_hashes(spec: Spec):
    def run(table: pa.Table) -> pa.Table:
        sent = bytes_of(table["hashes"].combine_chunks())
        values = np.frombuffer(b"".join(sent), "<u8")
        counts = np.frombuffer(b"".join(bytes_of(table["counts"].combine_chunks())), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(sent)), [len(x) // 8 for x in sent])
        order = np.argsort(values, kind="stable")
        v = values[order]
        head = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, int)
        total = np.add.reduceat(counts[order], head) if len(v) else np.zeros(0, int)
        total = np.repeat(total, np.diff(np.append(head, len(v))))
        some = total > 1
        who, what, hot = owner[order][some], v[some], total[some] > spec.hot
        by = np.argsort(who, kind="stable")
        who, what, hot = who[by], what[by], hot[by]
        cuts = np.append(np.flatnonzero(np.diff(who, prepend=-1)), len(who))
        pids = table["pid"].to_numpy()
        parts = list(zip(cuts[:-1], cuts[1:]))
        return pa.table({
            "pid": pa.array([pids[who[a]] for a, _ in parts], pa.int64()),
            "hashes": pa.array([what[a:b].tobytes() for a, b in parts], pa.binary()),
            "hot": pa.array([what[a:b][hot[a:b]].tobytes() for a, b in parts], pa.binary()),
        })

    return run


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


#: A segment's description: key, doc_id, rank of the row in its group, start.
_ABOUT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<i8"), ("size", "<i8")])
#: A repeat: row, first and last byte's end.
_SPAN = np.dtype([("row", "<i8"), ("start", "<i8"), ("end", "<i8")])
_NULL = -(2**63)

SENT = "slot long, pid long, about binary, bytes binary"


def _send_segments(spec: Spec, slots: int):
    def run(key, docs, asked):
        if not docs.num_rows or not asked.num_rows:
            return pa.table({"slot": pa.array([], pa.int64()), "pid": pa.array([], pa.int64()), "about": pa.array([], pa.binary()), "bytes": pa.array([], pa.binary())})
        known = np.sort(np.frombuffer(b"".join(bytes_of(asked["hashes"].combine_chunks())), "<u8"))
        hot = np.sort(np.frombuffer(b"".join(bytes_of(asked["hot"].combine_chunks())), "<u8"))
        seen: set[bytes] = set()
        about, parts, spans = [], [], []
        for row, (doc, text) in enumerate(_rows(docs)):
            lo, hi, h = anchor_runs(text, spec)
            pick = _among(h, known)
            lo, hi, h = lo[pick], hi[pick], h[pick]
            dealt = _among(h, hot).tolist() if len(hot) else [False] * len(h)
            for a, b, k, one_by_one in zip(lo.tolist(), hi.tolist(), h.tolist(), dealt):
                for s, e in ((p, p) for p in range(a, b + 1)) if one_by_one else ((a, b),):
                    content = text[s : e + spec.length]
                    if content in seen:
                        spans.append((row, s, e + spec.length))
                        continue
                    seen.add(content)
                    if one_by_one:
                        k = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")
                    about.append((k, _NULL if doc is None else doc, row, s, len(content)))
                    parts.append(content)
        described = np.array(about, _ABOUT)
        order = np.argsort(described["key"], kind="stable")
        slot = _slot(described["key"][order], slots).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
        pairs = list(zip(cuts[:-1], cuts[1:]))
        pid = key[0].as_py()
        out_slot = [int(slot[a]) for a, _ in pairs]
        out_about = [described[order[a:b]].tobytes() for a, b in pairs]
        out_bytes = [b"".join(parts[i] for i in order[a:b]) for a, b in pairs]
        if spans:  # repeats known here travel along as a slot of their own
            out_slot.append(-1 - pid)
            out_about.append(np.array(spans, _SPAN).tobytes())
            out_bytes.append(b"")
        return pa.table({
            "slot": pa.array(out_slot, pa.int64()), "pid": pa.array([pid] * len(out_slot), pa.int64()),
            "about": pa.array(out_about, pa.binary()), "bytes": pa.array(out_bytes, pa.binary()),
        })

    return run


def _sorted_batches(described: np.ndarray, owner: np.ndarray, contents: list[bytes], spec: Spec):
    """Repeats (owner, row, start, end) of segments that met, in batches of whole keys."""
    order = np.lexsort((described["lo"], described["row"], described["doc"], described["key"]))
    keys = described["key"][order]
    cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, int)
    found: list[tuple[int, int, int, int]] = []
    batch: list[int] = []
    held = 0

    def flush():
        ranked = sorted(batch, key=lambda i: (described["doc"][i], owner[i], described["row"][i], described["lo"][i]))
        for i, starts in zip(ranked, repeated_starts([contents[i] for i in ranked], spec.length)):
            if len(starts):
                edge = np.flatnonzero(np.diff(starts) > 1)
                first, last = starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)]
                lo, row = described["lo"][i], described["row"][i]
                found.extend((owner[i], row, lo + a, lo + b + spec.length) for a, b in zip(first, last))

    for a, b in zip(cuts[:-1], cuts[1:]):
        first: dict[bytes, int] = {}
        for i in order[a:b].tolist():
            if contents[i] in first:
                found.append((owner[i], described["row"][i], described["lo"][i], described["lo"][i] + described["size"][i]))
            else:
                first[contents[i]] = i
        if len(first) > 1:  # a lone content has nothing to be compared with
            batch.extend(first.values())
            held += sum(map(len, first))
            if held >= spec.batch_bytes:
                flush()
                batch, held = [], 0
    if batch:
        flush()
    return found


def _find_repeats(spec: Spec):
    def run(key, table):
        if key[0].as_py() < 0:
            return table.select(["pid", "about"]).rename_columns(["pid", "spans"])
        about = [np.frombuffer(x, _ABOUT) for x in bytes_of(table["about"].combine_chunks())]
        owner = np.repeat(table["pid"].to_numpy(), [len(x) for x in about])
        described = np.concatenate(about)
        data = b"".join(bytes_of(table["bytes"].combine_chunks()))
        ends = np.cumsum(described["size"]).tolist()
        contents = [data[e - s : e] for s, e in zip(described["size"].tolist(), ends)]
        found = sorted(_sorted_batches(described, owner, contents, spec))
        rows: dict[int, list] = {}
        for pid, *span in found:
            rows.setdefault(int(pid), []).append(tuple(span))
        return pa.table({
            "pid": pa.array(list(rows), pa.int64()),
            "spans": pa.array([np.array(v, _SPAN).tobytes() for v in rows.values()], pa.binary()),
        })

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def _cut_out(keep_bytes: bool):
    def run(docs, repeats):
        sent = bytes_of(repeats["spans"].combine_chunks()) if repeats.num_rows else []
        spans = np.concatenate([np.frombuffer(x, _SPAN) for x in sent]) if sent else np.zeros(0, _SPAN)
        spans = spans[np.lexsort((spans["start"], spans["row"]))]
        rows = _rows(docs)
        cuts = np.searchsorted(spans["row"], np.arange(len(rows) + 1))
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept")}
        for row, (doc, text) in enumerate(rows):
            own = spans[cuts[row] : cuts[row + 1]]
            start, end = own["start"], np.maximum.accumulate(own["end"]) if len(own) else own["end"]
            head = np.append(True, start[1:] > end[:-1]) if len(own) else np.zeros(0, bool)
            starts, ends = start[head], end[np.append(head[1:], True)] if len(own) else end
            pieces, at = [], 0
            for a, b in zip(starts.tolist(), ends.tolist()):
                pieces.append(text[at:a])
                at = b
            kept = b"".join([*pieces, text[at:]])
            for k, v in zip(out, (doc, len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), starts, ends, kept)):
                out[k].append(v)
        if not keep_bytes:
            del out["kept"]
        kinds = {"kept_sha256": pa.string(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kept": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def remove_repeats(docs: DataFrame, spec: Spec = Spec(), doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Per document: sizes, removed byte runs (starts, ends), digest of what is left and, if asked for, the bytes left."""
    if not spec.gram < spec.length <= 512:
        raise ValueError("grams must be shorter than strings, and strings at most 512 bytes")
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-total // spec.group_bytes), least)
    slots = max(-(-total // (4 * spec.group_bytes)), least)
    dealt = slim.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("pid"), "doc_id", "text")
    hashes = dealt.groupBy("pid").applyInArrow(_send_hashes(spec, slots), "slot long, pid long, hashes binary, counts binary")
    repeated = hashes.groupBy("slot").applyInArrow(_repeated_hashes(spec), "pid long, hashes binary, hot binary")
    segments = dealt.groupBy("pid").cogroup(repeated.groupBy("pid")).applyInArrow(_send_segments(spec, slots), SENT)
    repeats = segments.groupBy("slot").applyInArrow(_find_repeats(spec), "pid long, spans binary")
    result = RESULT + (", kept binary" if keep_bytes else "")
    return dealt.groupBy("pid").cogroup(repeats.groupBy("pid")).applyInArrow(_cut_out(keep_bytes), result)
