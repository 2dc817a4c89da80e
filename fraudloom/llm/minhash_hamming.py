"""MinHash near-duplicates by a multi-index Hamming join (operator 6).

A text's set holds its distinct word shingles. Each set gets a signature of
``n`` minimum hashes of ``b`` bits. Two sets of similarity J differ in any one
place of their signatures with probability 1 - J (up to 2**-b), so a linked pair
differs in more than ``distance`` places only with the binomial tail that
``Plan.miss`` gives: under 1e-6 at a similarity of exactly 0.85 with the defaults.

All pairs within ``distance`` are found: the signature is split into ``chunks``;
by the pigeonhole principle one chunk has at most distance // chunks differences,
and every way to leave out that many places of a chunk makes a key that both
share. Keys hold the values themselves, not hashes of them.

Links are confirmed on full sets. No group is expanded into its pairs:

1. texts with equal words are one class;
2. in every bucket (key), all members are compared with its smallest member;
   confirmed links give components;
3. buckets that still hold several components are compared in numpy, many small ones
   at a time and large ones block by block, between components only, and only pairs
   that an exact bound on their similarity lets through are confirmed: first a
   spanning forest of them, then, in the buckets where the forest left pairs out, all
   that still lie between components;
4. before that, every member of a crowded bucket counts how many of its shingles
   occur in another component of the crowd at all. No intersection with another
   component can be larger, so members with too few of them for any size that they
   could meet leave the bucket unpaired. In what is left, the members of a large
   bucket's main component meet only those outside it.

Defined results: empty and null texts have an empty set and no links; texts with
fewer words than a shingle are one shingle of all their words; rows sharing a
doc_id are one document; rows without doc_id join a class but never lead it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.common import annotate, bytes_of, fresh, parts_by_bytes
from fraudloom.operators.components import connected_components
from fraudloom.plans.sizing import sized
from fraudloom.session import cut_lineage, settled

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Rows of a block when a bucket's members are compared.
BLOCK = 512
#: Signatures whose keys one task makes: it holds all their keys at once, many for each.
KEYED = 1 << 14
#: Members of small buckets that are compared in one call.
GROUP = 4096
#: Bins of the counts that bound two sets' similarity from above.
BINS = 256
#: Buckets with more members are crowded: their members' shingles are looked up among the others'.
CROWD = 64
#: Shingles that are looked up in one call.
SLOT = 1 << 17
#: Times that the crowd is counted anew without those who have left.
ROUNDS = 2


@dataclass(frozen=True)
class Plan:
    """How texts are shingled, signed and linked."""

    words: int = 3
    percent: int = 85  # links have 100 * intersection >= percent * union
    n: int = 40
    bits: int = 16
    chunks: int = 10
    distance: int = 19

    @property
    def errors(self) -> int:
        return self.distance // self.chunks

    def key_places(self) -> list[tuple[int, ...]]:
        """Places of the signature that make up each key."""
        bounds = np.linspace(0, self.n, self.chunks + 1).astype(int)
        found = []
        for lo, hi in zip(bounds, bounds[1:]):
            found += combinations(range(lo, hi), max(hi - lo - self.errors, 1))
        return found

    def miss(self, similarity: float) -> float:
        """Probability that a pair of this similarity differs in more than ``distance`` places."""
        p = (1 - similarity) * (1 - 2.0**-self.bits)
        return sum(comb(self.n, i) * p**i * (1 - p) ** (self.n - i) for i in range(self.distance + 1, self.n + 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when full."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_HASHES = _WordHashes()


def folded_words(data: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return data.lower().split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def _seeds(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    made = _mix(np.arange(1, 2 * plan.n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return made[: plan.n], made[plan.n :] | np.uint64(1)


def signatures(sets: list[np.ndarray], plan: Plan) -> np.ndarray:
    """One row of ``n`` b-bit minimum hashes per set; no set may be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    xor, odd = _seeds(plan)
    out = np.empty((len(sets), plan.n), np.uint16 if plan.bits <= 16 else np.uint32)
    keep = np.uint64(2**plan.bits - 1)
    for i in range(plan.n):
        v = (flat ^ xor[i]) * odd[i]
        v ^= v >> np.uint64(32)
        least = np.minimum.reduceat(v * odd[-1 - i], starts)
        out[:, i] = (least >> np.uint64(20)) & keep
    return out


def bin_counts(s: np.ndarray) -> np.ndarray:
    """How many hashes of a set fall into each bin. Counts stop at 255, which only loosens the bound below."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


SIGNED = "n_shingles long, words_md5 binary, signature binary, bins binary"


def _signer(plan: Plan):
    def rows(texts: list[bytes]) -> Iterable[tuple]:
        for some in parts_by_bytes(texts):
            part = [folded_words(t) for t in some]
            sets = [shingle_set(w, plan.words) for w in part]
            full = [s for s in sets if len(s)]
            made = iter(signatures(full, plan)) if full else iter(())
            for words, s in zip(part, sets):
                if len(s):
                    digest = hashlib.md5(b" ".join(words)).digest()
                    yield len(s), digest, next(made).tobytes(), bin_counts(s).tobytes()
                else:
                    yield 0, None, None, None

    return rows


def sign(docs: DataFrame, name: str, plan: Plan, text: str = "text") -> DataFrame:
    """``docs`` with a struct column: set size, digest of the folded words, signature and bins."""
    return annotate(docs, name, SIGNED, _signer(plan), text)


def bucket_keys(signed: DataFrame, plan: Plan) -> DataFrame:
    """(key, id): every key of every signature; ``signed`` has id and signature.

    A key is its number in ``key_places`` and the b-bit values at those places.
    """
    places = plan.key_places()
    width = 2 if plan.bits <= 16 else 4
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            sig = np.frombuffer(b"".join(bytes_of(batch.column(1))), kind).reshape(len(ids), -1)
            for number, where in enumerate(places):
                own = np.ascontiguousarray(sig[:, where]).view(f"V{width * len(where)}").ravel()
                head = number.to_bytes(2, "little")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([head + x.tobytes() for x in own], pa.binary()), pa.array(ids, pa.int64())], names=["key", "id"]
                )

    return signed.select("id", "signature").mapInArrow(run, "key binary, id long")


def grows(table: DataFrame) -> DataFrame:
    """A join side that grows with the documents: never broadcast, so that the plan is the same at every size."""
    return table.hint("merge")


def _distance(plan: Plan, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def close_pairs(pairs: DataFrame, signed: DataFrame, plan: Plan) -> DataFrame:
    """Those of ``pairs`` (a, b) whose signatures are within the distance and whose set sizes allow a link."""
    side = signed.select("id", "signature", "n_shingles")
    left = side.select(F.col("id").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    right = side.select(F.col("id").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    both = pairs.join(grows(left), "a").join(grows(right), "b").filter(
        100 * F.least("na", "nb") >= plan.percent * F.greatest("na", "nb")
    )

    kind = "<u2" if plan.bits <= 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(bytes_of(batch.column(i))), kind).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(_distance(plan, sa, sb) <= plan.distance))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has id and text."""
    asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # few ids are sent to the texts, so that these need not be dealt out by id
    needed = texts.join(sized(asked, asked.count(), 8), "id", "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(folded_words(t), plan.words).tobytes() for t in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "s"])

    sets = cut_lineage(needed.select("id", "text").mapInArrow(to_sets, "id long, s binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(bytes_of(batch.column(2)), bytes_of(batch.column(3))):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= plan.percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = (
        sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).join(sized(pairs, pairs.count(), 16), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .select("a", "b", "sa", "sb")
    )
    return both.mapInArrow(run, "a long, b long")


def _group_pairs(plan: Plan, spanning: bool):
    """Compare the members of one group: whole small buckets, or two blocks of a large one.

    Gives the passing pairs between components. With ``spanning`` only a forest of
    them, and the keys of the buckets in which pairs were left out.
    """
    kind = "<u2" if plan.bits <= 16 else "<u4"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("side", "ascending"), ("id", "ascending")]).combine_chunks()
        side = table["side"].to_numpy()
        ids, comp, size = (table[c].to_numpy() for c in ("id", "component", "n_shingles"))
        covered = table["covered"].fill_null(-1).to_numpy()
        sig = np.frombuffer(b"".join(bytes_of(table["signature"].combine_chunks())), kind).reshape(len(ids), -1)
        bins = np.frombuffer(b"".join(bytes_of(table["bins"].combine_chunks())), np.uint8).reshape(len(ids), -1)
        keys = bytes_of(table["key"].combine_chunks())
        new = np.array([True, *(x != y for x, y in zip(keys, keys[1:]))])
        start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        end = np.append(np.flatnonzero(new)[1:], len(ids))[np.cumsum(new) - 1]
        # a member meets those behind it in its bucket, or those of the other block
        second = np.where(side == 1, len(ids), np.arange(len(ids)) + 1)
        if (side == 1).any():
            second = np.where(side == 0, start + int((side == 0).sum()), len(ids))
        found = []
        open_to, step = np.flatnonzero(second < end), 0
        while len(open_to):
            a, b = open_to, second[open_to] + step
            step += 1
            open_to = open_to[b + 1 < end[open_to]]
            keep = comp[a] != comp[b]
            a, b = a[keep], b[keep]
            keep = 100 * np.minimum(size[a], size[b]) >= plan.percent * np.maximum(size[a], size[b])
            a, b = a[keep], b[keep]
            # the intersection is at most ``covered`` where that is known for both; see coverage
            most = np.minimum(covered[a], covered[b])
            keep = (most < 0) | ((100 + plan.percent) * most >= plan.percent * (size[a] + size[b]))
            a, b = a[keep], b[keep]
            keep = _distance(plan, sig[a], sig[b]) <= plan.distance
            a, b = a[keep], b[keep]
            total = size[a] + size[b]
            apart = np.abs(bins[a].astype(np.int16) - bins[b]).sum(axis=1)
            # the symmetric difference is at least ``apart``; see bin_counts
            keep = 100 * (total - apart) >= plan.percent * (total + apart)
            found.append((a[keep], b[keep]))
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
        left_out: list[bytes] = []
        if spanning and len(a):
            keep = _forest(comp[a], comp[b])
            left_out = sorted({keys[i] for i in np.delete(a, keep).tolist()})
            a, b = a[keep], b[keep]
        x, y, none = ids[a], ids[b], [None] * len(left_out)
        return pa.table({
            "a": pa.array([*np.minimum(x, y).tolist(), *none], pa.int64()), "b": pa.array([*np.maximum(x, y).tolist(), *none], pa.int64()),
            "key": pa.array([*([None] * len(x)), *left_out], pa.binary()),
        })

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of edges that make a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep.append(i)
    return np.asarray(keep, np.int64)


def coverage(crowd: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """(id, covered): how many of an id's shingles another component of the crowd has, too.

    ``crowd`` has id, component and n_shingles. An intersection of two of its members
    of different components is no larger than either's count. Ids with several
    different texts have no count. Shingles are dealt out by their hashes and travel
    packed, one row for all that a text has in one slot.
    """
    sizes = crowd.agg(F.sum("n_shingles").alias("shingles"), F.count(F.lit(1)).alias("n")).first()
    slots = -(-(sizes["shingles"] or 0) // SLOT) or 1
    needed = texts.join(sized(crowd.select("id", "component"), sizes["n"], 16), "id")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))):
                s = shingle_set(folded_words(text), plan.words)
                mark = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                at = s % np.uint64(slots)
                order = np.argsort(at, kind="stable")
                there, first = np.unique(at[order], return_index=True)
                parts = np.split(s[order], first[1:])
                rows += [(int(k), i, component, mark, part.tobytes()) for k, part in zip(there, parts)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())],
                names=["slot", "id", "component", "mark", "s"],
            )

    def count(table: pa.Table) -> pa.Table:
        table = table.group_by(["id", "mark"]).aggregate([("component", "min"), ("s", "min")])
        held = [np.frombuffer(x, "<u8") for x in bytes_of(table["s_min"].combine_chunks())]
        owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
        flat = np.concatenate(held)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        component = table["component_min"].to_numpy()[owner]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        several = np.minimum.reduceat(component, first) < np.maximum.reduceat(component, first)
        met = owner[np.repeat(several, np.diff(np.append(first, len(flat))))]
        return pa.table({"id": table["id"], "mark": table["mark"], "n": np.bincount(met, minlength=len(held)).astype(np.int64)})

    dealt = needed.select("id", "component", "text").mapInArrow(deal, "slot long, id long, component long, mark long, s binary")
    counted = dealt.groupBy("slot").applyInArrow(count, "id long, mark long, n long")
    return counted.groupBy("id").agg(
        F.sum("n").alias("covered"), F.min("mark").alias("lo"), F.max("mark").alias("hi")
    ).filter("lo = hi").select("id", "covered")


def crowd_coverage(buckets: DataFrame, state: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """(id, covered) of the members of crowded buckets; ``buckets`` has key, id and m.

    A count holds for the pairs inside crowded buckets: who has left one by an
    earlier count has nobody to be linked with there, and is not counted for others.
    """
    cover = state.sparkSession.createDataFrame([], "id long, covered long")
    crowded = cut_lineage(buckets.filter(F.col("m") > CROWD))
    for _ in range(ROUNDS):
        members = _members(crowded, state, cover, plan)
        mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        ids = members.join(grows(mixed), "key").select("id").distinct()
        crowd = cut_lineage(ids.join(grows(state.select("id", "component", "n_shingles")), "id"))
        if crowd.isEmpty():
            break
        counts = cover.unionByName(coverage(crowd, texts, plan))
        cover = cut_lineage(counts.groupBy("id").agg(F.min("covered").alias("covered")))
    return cover


def _members(buckets: DataFrame, state: DataFrame, cover: DataFrame, plan: Plan) -> DataFrame:
    """(key, id, component, covered): members that another component of their bucket could be linked with, by sizes and coverage.

    ``covered`` is null outside crowded buckets, where not everybody has been
    counted. Sizes are gathered in bands, whose own bounds are used: a bucket has
    few bands however many members.
    """
    owner = state.select("id", "component", "n_shingles").join(grows(cover), "id", "left")
    placed = buckets.select("key", "id", "m").join(grows(owner), "id").withColumn("covered", F.when(F.col("m") > CROWD, F.col("covered")))
    bands = placed.groupBy("key", F.floor(F.log2("n_shingles") * 8).alias("band")).agg(
        F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"),
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("covered").isNull()).alias("unknown"),
    )
    mixed = bands.groupBy("key").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("least", "most", "lo", "hi", "unknown")).alias("bands")
    ).filter("lo < hi").select("key", "bands")

    def could_link(band):
        sizes = (100 * band["most"] >= plan.percent * F.col("n_shingles")) & (plan.percent * band["least"] <= 100 * F.col("n_shingles"))
        enough = (100 + plan.percent) * F.col("covered") >= plan.percent * (F.col("n_shingles") + band["least"])
        return sizes & (F.col("covered").isNull() | band["unknown"] | enough) & ((band["lo"] != F.col("component")) | (band["hi"] != F.col("component")))

    return cut_lineage(placed.join(grows(mixed), "key").filter(F.exists("bands", could_link)).select("key", "id", "component", "covered"))


def cross_pairs(buckets: DataFrame, state: DataFrame, cover: DataFrame, plan: Plan, spanning: bool) -> DataFrame:
    """(a, b, key): pairs between components inside the buckets that pass the similarity bound.

    ``buckets`` has key, id and m, its number of members; ``state`` id, component,
    n_shingles, signature and bins; ``cover`` id and covered. What is left of a bucket
    is compared whole, many at a time, if that is up to ``BLOCK`` members; a larger
    one is dealt into blocks, and each pair of blocks is one group, so that no group
    grows with its bucket. The blocks of the bucket's largest component do not meet
    each other. With ``spanning`` a forest of the pairs is given, and rows with a key
    alone name the buckets that hold others.
    """
    members = _members(buckets, state, cover, plan)
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = cut_lineage(parts.groupBy("key").agg(
        F.sum("n").alias("m"), F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")
    ).filter("components > 1").select(
        "key", "m", F.col("main.component").alias("main"),
        F.when(F.col("m") > BLOCK, F.ceil(F.col("main.n") / BLOCK)).alias("inner"),
        F.when(F.col("m") > BLOCK, F.ceil((F.col("m") - F.col("main.n")) / BLOCK)).alias("outer"),
    ))
    small = mixed.filter("inner IS NULL").agg(F.sum("m").alias("m")).first()["m"] or 0
    slots = -(-small // GROUP) or 1
    dealt = members.join(grows(mixed), "key").withColumn(
        "block", F.when(F.col("component") == F.col("main"), F.pmod(F.xxhash64("id"), "inner")).otherwise(F.col("inner") + F.pmod(F.xxhash64("id"), "outer"))
    )
    # block i meets block j >= i: side 0 in (i, j), side 1 in (j', i) for j' < i
    others = F.sequence(F.when(F.col("block") < F.col("inner"), F.col("inner")).otherwise(F.lit(0)), F.col("inner") + F.col("outer") - 1)
    met = dealt.withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0).cast("long"))))).select(
        "key", "id", "covered", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.coalesce((F.col("block") > F.col("other")).cast("int"), F.lit(0)).alias("side"),
        F.when(F.col("inner").isNull(), F.pmod(F.xxhash64("key"), F.lit(slots))).alias("slot"),
        F.when(F.col("inner").isNotNull(), F.col("key")).alias("large"),
    )
    full = met.join(grows(state), "id")
    return full.groupBy("slot", "large", "i", "j").applyInArrow(_group_pairs(plan, spanning), "a long, b long, key binary").distinct()


def _linked(state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` with the components that ``links`` join together."""
    owner = state.select("id", "component")
    joined = links.join(owner.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(
        owner.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b"
    ).select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct()
    joined = cut_lineage(joined)
    if joined.isEmpty():
        return state
    nodes = joined.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    merged = connected_components(nodes, joined).select(F.col("component").alias("_to"), F.col("node").alias("component"))
    return cut_lineage(
        state.join(merged, "component", "left").withColumn("component", F.coalesce("_to", "component")).drop("_to")
        .select(*state.columns)
    )


def _confirmed(state: DataFrame, pairs: DataFrame, tested: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """``state`` with the components that those of ``pairs`` join which were not tested before."""
    pairs = cut_lineage(pairs.join(tested, ["a", "b"], "left_anti"))
    return state if pairs.isEmpty() else _linked(state, cut_lineage(confirm(pairs, texts, plan)))


def near_components(signed: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """(id, component) of classes. ``signed`` has id, n_shingles, signature, bins; ``texts`` id and text."""
    state = cut_lineage(signed.select("id", F.col("id").alias("component"), "n_shingles", "signature", "bins"))
    dealt = state.select("id", "signature").repartition(-(-state.count() // KEYED) or 1, "id")
    keys = bucket_keys(dealt, plan)
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count(F.lit(1)).alias("m")).filter("hub < last").drop("last")
    buckets = cut_lineage(keys.join(grows(hubs), "key"))
    star = buckets.filter("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    found = cut_lineage(close_pairs(star, state, plan))
    state = _linked(state, cut_lineage(confirm(found, texts, plan)))
    buckets = buckets.drop("hub")
    cover = crowd_coverage(buckets, state, texts, plan)
    first = cut_lineage(cross_pairs(buckets, state, cover, plan, spanning=True))
    tested = found.unionByName(first.filter("key IS NULL").select("a", "b"))
    state = _confirmed(state, first.filter("key IS NULL").select("a", "b"), found, texts, plan)
    left_out = first.filter("key IS NOT NULL").select("key").distinct()
    if not left_out.isEmpty():
        rest = cross_pairs(buckets.join(left_out, "key", "left_semi"), state, cover, plan, spanning=False)
        state = _confirmed(state, rest.select("a", "b"), tested, texts, plan)
    return state.select("id", "component")


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    component_id is the least doc_id reachable over links. A doc_id with several
    texts is compared by one of them and joins the components of all.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = cut_lineage(sign(slim, "s", plan).select("doc_id", "s.*"))
    classes = cut_lineage(
        signed.filter("words_md5 IS NOT NULL AND doc_id IS NOT NULL").groupBy("words_md5").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"), F.first("bins").alias("bins"),
        )
    )
    heads = classes.groupBy("id").agg(*(F.min_by(c, "words_md5").alias(c) for c in ("n_shingles", "signature", "bins")))
    texts = slim.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    found = near_components(heads, texts, plan)
    by_words = cut_lineage(classes.select("words_md5", "id").join(found, "id").select("words_md5", "component"))
    joined = signed.select("doc_id", "n_shingles", "words_md5").join(by_words, "words_md5", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id") -> DataFrame:
    """One document of each group, with all columns. Rows without doc_id stay; repeated rows of one doc_id become one."""
    def leading() -> DataFrame:
        return near_duplicates(docs, plan, doc_id).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))

    kept = settled(docs.sparkSession, leading)
    mark = fresh(docs, "kept_id")
    joined = docs.join(grows(kept.select(F.col("doc_id").alias(mark))), F.col(doc_id) == F.col(mark), "left")
    stay = joined.filter(F.col(mark).isNotNull() | F.col(doc_id).isNull()).drop(mark)
    if not kept.filter("n > 1").isEmpty():
        known = stay.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
        stay = known.unionByName(stay.filter(F.col(doc_id).isNull()))
    return stay.select(*docs.columns)
