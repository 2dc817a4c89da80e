"""Vector codes from per-part codebooks, fitted over anchors-hierarchy metric trees.

A vector is cut into equal consecutive parts; each part becomes the index of its
codebook's nearest entry. Components are scaled and floored to integers, so that all
distances, sums and codebooks are exact and do not depend on partitioning.

* Vectors are dealt out in blocks of at most ``BLOCK`` rows. Per part, a block builds
  a metric tree middle-out (Moore 2000): about sqrt(n) anchors, each new one the point
  farthest from the widest anchor and taking only points that the triangle inequality
  leaves open; each anchor's points are split in the same way; the anchors' balls are
  then merged upwards, the pair with the smallest common ball first. Every ball caches
  its sum and count; its centre is their quotient. Trees are built once and written.
* A round walks all trees of a block level by level. The list of entries that may be
  nearest is inherited from the parent ball and shrinks: an entry goes when the ball's
  best entry beats it everywhere inside. A ball with one entry left is wholly owned:
  its cached sum and count are added and none of its points is read. Only points of
  balls that end undecided are compared, and only with what is left of the list.
* Per task, sums and counts of all entries are added up before the shuffle; what visits
  the driver is the codebooks, ``parts * entries`` rows whatever the table's size.

Results on awkward input: rows whose vector is null or holds a null or non-finite
component are dropped. The dimension is that of the smallest kept id's vector; vectors
of another length, and all vectors if it is not divisible by ``parts``, raise an error
that says so, as do components too large for exact distances (2**22 times the unit of
1/scale, at 64 dimensions). Null ids come after all others. With fewer vectors than
entries the codebooks are shorter. Repeated rows get the same code; equal entries
resolve to the lower index. Null labels form one group. Other columns are not returned,
whatever their names. An empty table gives an empty table and no codebooks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from fraudloom.llm.common import sha256_hex
from fraudloom.plans.sizing import KeyProfile, hot_share, join_back
from fraudloom.session import cut_lineage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors of one block; one task holds a block's trees at a time.
BLOCK = 4096
#: A ball of at most so many points is not split.
LEAF = 32


# ---- trees ------------------------------------------------------------------------


@dataclass
class Tree:
    """Balls in numpy arrays. Points stand in tree order, so a ball is the range [first, last)."""

    order: np.ndarray  # row of each point
    points: np.ndarray  # in tree order, whole numbers held as doubles
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray  # child balls, -1 in leaves
    right: np.ndarray
    sums: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def _anchors(points: np.ndarray) -> list[np.ndarray]:
    """Rows of ``points`` by anchor: about sqrt(n) groups, none empty."""
    wanted = int(np.ceil(np.sqrt(len(points))))
    gap = np.sqrt(((points - points[0]) ** 2).sum(1))
    far = np.argsort(-gap, kind="stable")
    pivots, rows, gaps = [points[0]], [far], [gap[far]]  # each anchor's rows from far to near
    while len(rows) < wanted:
        widest = max(range(len(rows)), key=lambda i: gaps[i][0])
        if gaps[widest][0] <= 0:
            break
        pivot = points[rows[widest][0]]
        apart = np.sqrt(((np.asarray(pivots) - pivot) ** 2).sum(1))
        won_rows, won_gaps = [], []
        for i, limit in enumerate(apart / 2):
            # points nearer than half the anchors' distance cannot change hands
            open_to = int(np.searchsorted(-gaps[i], -limit, side="right"))
            if not open_to:
                continue
            other = np.sqrt(((points[rows[i][:open_to]] - pivot) ** 2).sum(1))
            goes = other < gaps[i][:open_to]
            if goes.any():
                won_rows.append(rows[i][:open_to][goes])
                won_gaps.append(other[goes])
                stays = np.concatenate([~goes, np.ones(len(rows[i]) - open_to, bool)])
                rows[i], gaps[i] = rows[i][stays], gaps[i][stays]
        taken, near = np.concatenate(won_rows), np.concatenate(won_gaps)
        far = np.argsort(-near, kind="stable")
        pivots.append(pivot)
        rows.append(taken[far])
        gaps.append(near[far])
        kept = [i for i, r in enumerate(rows) if len(r)]
        pivots, rows, gaps = [pivots[i] for i in kept], [rows[i] for i in kept], [gaps[i] for i in kept]
    return rows


def _merged(members: list[np.ndarray], points: np.ndarray) -> list[tuple]:
    """Pairs (i, j) in merging order; the n-th pair makes ball ``len(members) + n``."""
    total = np.array([points[m].sum(0) for m in members])
    count = np.array([len(m) for m in members], float)
    centre = total / count[:, None]
    reach = np.array([np.sqrt(((points[m] - c) ** 2).sum(1).max()) for m, c in zip(members, centre)])
    names, pairs = np.arange(len(members)), []

    def common(i, js):
        """Radius of the ball around i's and each j's points, seen from their common centre."""
        c = (total[i] + total[js]) / (count[i] + count[js])[:, None]
        return np.maximum(
            np.sqrt(((c - centre[i]) ** 2).sum(1)) + reach[i], np.sqrt(((c - centre[js]) ** 2).sum(1)) + reach[js]
        )

    n = len(members)
    cost = np.full((n, n), np.inf)
    for i in range(n - 1):
        cost[i, i + 1 :] = common(i, np.arange(i + 1, n))
    alive = np.ones(n, bool)
    for made in range(n - 1):
        i, j = divmod(int(np.argmin(cost)), n)
        pairs.append((int(names[i]), int(names[j])))
        reach[i], names[i] = cost[i, j], n + made
        total[i] += total[j]
        count[i] += count[j]
        centre[i] = total[i] / count[i]
        alive[j] = False
        cost[j, :] = cost[:, j] = np.inf
        others = np.flatnonzero(alive)
        others = others[others != i]
        if len(others):
            fresh = common(i, others)
            cost[np.minimum(i, others), np.maximum(i, others)] = fresh
    return pairs


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The anchors hierarchy over ``points`` (at least one row of whole numbers)."""
    balls: list[tuple[int, int]] = []  # children
    own: list[np.ndarray | None] = []  # rows of leaves

    def grow(rows: np.ndarray) -> int:
        groups = _anchors(points[rows]) if len(rows) > leaf else [np.arange(len(rows))]
        if len(groups) == 1:
            balls.append((-1, -1))
            own.append(rows)
            return len(balls) - 1
        members = [rows[g] for g in groups]
        ids = [grow(m) for m in members]
        for i, j in _merged(members, points):
            balls.append((ids[i], ids[j]))
            own.append(None)
            ids.append(len(balls) - 1)
        return ids[-1]

    root = grow(np.arange(len(points)))
    # balls from the root down, so that children follow their parents
    sequence, stack = [], [root]
    while stack:
        at = stack.pop()
        sequence.append(at)
        if balls[at][0] >= 0:
            stack += [balls[at][1], balls[at][0]]
    place = {ball: i for i, ball in enumerate(sequence)}
    left = np.array([place.get(balls[b][0], -1) for b in sequence])
    right = np.array([place.get(balls[b][1], -1) for b in sequence])
    order = np.concatenate([own[b] for b in sequence if own[b] is not None])
    first, last = np.zeros(len(sequence), int), np.zeros(len(sequence), int)
    seen = 0
    for i, b in enumerate(sequence):
        if own[b] is not None:
            first[i], last[i] = seen, seen + len(own[b])
            seen = last[i]
    for i in range(len(sequence) - 1, -1, -1):
        if left[i] >= 0:
            first[i], last[i] = first[left[i]], last[right[i]]
    placed = points[order]
    upto = np.concatenate([np.zeros((1, points.shape[1])), np.cumsum(placed, axis=0)])
    sums = upto[last] - upto[first]
    centre = sums / (last - first)[:, None]
    radius = np.array([np.sqrt(((placed[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(first, last, centre)])
    return Tree(order, placed, first, last, left, right, sums, centre, radius)


# ---- assignment -------------------------------------------------------------------


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` for each point, ties to the lower one, and its squared distance."""
    apart = (points**2).sum(1)[:, None] - 2 * points @ book.T + (book**2).sum(1)
    at = apart.argmin(1)
    return at, apart[np.arange(len(points)), at]


def walk(tree: Tree, book: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """(first, last, ball, None) where a ball is wholly owned, (first, last, -1, entries) where points were compared.

    For a wholly owned ball the fourth value is its one entry.
    """
    _, lowest = np.unique(book, axis=0, return_index=True)
    gaps = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(2), 0))
    length = (book**2).sum(1)
    balls = np.zeros(1, int)
    listed = np.zeros((1, len(book)), bool)  # a ball's list is a row of marks
    listed[0, lowest] = True  # of equal entries only the first can win
    while len(balls):
        centre = tree.centre[balls]
        apart = (centre**2).sum(1)[:, None] - 2 * centre @ book.T + length
        seen = np.where(listed, apart, np.inf)
        best = seen.argmin(1)
        least = seen[np.arange(len(balls)), best]
        # |x-e|^2 - |x-best|^2 is linear in x: over the ball it falls short of its
        # value at the centre by at most 2 * radius * |e - best|
        slack = 1e-9 * (length + (centre**2).sum(1)[:, None] + 1)
        listed &= seen - least[:, None] <= 2 * tree.radius[balls][:, None] * gaps[best] + slack
        left_over = listed.sum(1)
        inner = (left_over > 1) & (tree.left[balls] >= 0)
        for i in np.flatnonzero(~inner):
            ball, some = balls[i], np.flatnonzero(listed[i])
            a, b = int(tree.first[ball]), int(tree.last[ball])
            if len(some) == 1:
                yield a, b, int(ball), some
            else:
                at, _ = nearest(tree.points[a:b], book[some])
                yield a, b, -1, some[at]
        balls = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]])
        listed = np.concatenate([listed[inner]] * 2)


def entry_sums(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points nearest to each entry."""
    sums, counts = np.zeros((len(book), tree.points.shape[1]), np.int64), np.zeros(len(book), np.int64)
    for first, last, ball, entries in walk(tree, book):
        if ball >= 0:
            sums[entries[0]] += tree.sums[ball].astype(np.int64)
            counts[entries[0]] += last - first
        else:
            np.add.at(sums, entries, tree.points[first:last].astype(np.int64))
            np.add.at(counts, entries, 1)
    return sums, counts


def entries_of(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the order in which the points were given."""
    found = np.zeros(len(tree.points), int)
    for first, last, _, entries in walk(tree, book):
        found[first:last] = entries
    apart = ((tree.points - book[found]) ** 2).sum(1)
    at, error = np.empty_like(found), np.empty(len(found), np.int64)
    at[tree.order], error[tree.order] = found, apart.astype(np.int64)
    return at, error


# ---- Spark ------------------------------------------------------------------------

_FIELDS = ("order", "points", "first", "last", "left", "right", "sums", "centre", "radius")
_WHOLE = ("order", "points", "first", "last", "left", "right", "sums")


def _packed(tree: Tree) -> dict[str, bytes]:
    """The arrays as bytes: whole numbers of a tree's ranges and points fit 4 bytes, sums need 8."""
    kinds = {"sums": "<i8", "centre": "<f8", "radius": "<f8"}
    return {f: np.ascontiguousarray(getattr(tree, f)).astype(kinds.get(f, "<i4")).tobytes() for f in _FIELDS}


def _unpacked(packed: dict[str, bytes], width: int) -> Tree:
    kinds = {"sums": "<i8", "centre": "<f8", "radius": "<f8"}
    arrays = {f: np.frombuffer(packed[f], kinds.get(f, "<i4")) for f in _FIELDS}
    for f in ("points", "sums", "centre"):
        rows = len(arrays["order" if f == "points" else "first"])
        arrays[f] = arrays[f].reshape(rows, width).astype(float)
    return Tree(**{f: a.astype(int) if a.dtype == np.dtype("<i4") else a for f, a in arrays.items()})


def whole_numbers(vectors: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as doubles."""
    if any(len(v) != width for v in vectors):
        raise ValueError(f"all vectors must have {width} components")
    made = np.floor(np.asarray(vectors, float).reshape(len(vectors), width) * scale)
    if made.size and 4.0 * width * float(np.abs(made).max()) ** 2 >= 2.0**53:
        raise ValueError("components are too large for exact squared distances")
    return made


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, with finite components only."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(v.isNotNull() & F.coalesce(fine, F.lit(False)))


@dataclass(frozen=True)
class Codes:
    """One row per kept vector: (id, label, code, error), and the codebooks by part."""

    rows: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, joined by commas."""
        return sha256_hex(",".join(str(int(x)) for book in self.books for x in book.reshape(-1)).encode())


def compress(
    rows: DataFrame,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    block: int = BLOCK,
) -> Codes:
    """Fit the codebooks over all vectors and code every vector with them."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit two hex digits")
    kept = usable(rows, vector).select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    width = len(seeds[0]["v"]) if seeds else 0
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    books = list(np.split(whole_numbers([s["v"] for s in seeds], width, scale), parts, axis=1)) if seeds else []
    blocks = _blocks(kept, width, parts, scale, block)
    for _ in range(rounds if seeds else 0):
        books = _next_books(blocks, books)
    coded = _coded(blocks, books)
    # fewer rows than a codebook has entries leave in the order of the seeds, not of files
    return Codes(coded.orderBy(F.col("id").asc_nulls_last()) if len(seeds) < entries else coded, books)


def _blocks(kept: DataFrame, width: int, parts: int, scale: int, block: int) -> DataFrame:
    """Written blocks: ids, labels and one packed tree per part."""
    tree = ArrayType(StructType.fromDDL(", ".join(f"`{f}` binary" for f in _FIELDS)))
    schema = StructType([
        StructField("ids", ArrayType(kept.schema["id"].dataType)),
        StructField("labels", ArrayType(kept.schema["label"].dataType)),
        StructField("trees", tree),
    ])
    types = to_arrow_schema(schema)

    def made(columns: list[list]) -> pa.RecordBatch:
        ids, labels, vectors = columns
        cut = np.split(whole_numbers(vectors, width, scale), parts, axis=1)
        trees = [_packed(build_tree(np.ascontiguousarray(p))) for p in cut]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], f.type) for x, f in zip((ids, labels, trees), types)], names=["ids", "labels", "trees"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        for batch in batches:
            for have, column in zip(held, batch.columns):
                have += column.to_pylist()
            while len(held[0]) >= block:
                yield made([h[:block] for h in held])
                held = [h[block:] for h in held]
        if held[0]:
            yield made(held)

    return cut_lineage(kept.mapInArrow(run, schema))


def _next_books(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the floored mean of the parts nearest to it; entries without any stay."""
    shapes = [b.shape for b in books]
    width = shapes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(s, np.int64) for s in shapes], [np.zeros(s[0], np.int64) for s in shapes]
        for batch in batches:
            for trees in batch.column(0):
                for p, packed in enumerate(trees.as_py()):
                    more, n = entry_sums(_unpacked(packed, width), books[p])
                    sums[p] += more
                    counts[p] += n
        used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
             pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
             pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    added = blocks.select("trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    found = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect()
    fresh = [b.copy() for b in books]
    for row in found:
        fresh[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return fresh


def _coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    id_type, label_type = (blocks.schema[c].dataType.elementType for c in ("ids", "labels"))
    schema = StructType([StructField("id", id_type), StructField("label", label_type), *StructType.fromDDL("code string, error long")])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*(batch.column(i) for i in range(3))):
                found = [entries_of(_unpacked(packed, b.shape[1]), b) for packed, b in zip(trees.as_py(), books)]
                codes = [bytes(c).hex() for c in np.stack([at for at, _ in found], axis=1).astype(np.uint8)]
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(codes, types.field("code").type), pa.array(error, pa.int64())], names=types.names
                )

    return blocks.mapInArrow(run, schema)


def with_label_errors(codes: Codes) -> DataFrame:
    """The coded rows and ``label_error``: the errors of all rows with an equal label, added up."""
    key = F.when(F.col("label").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = cut_lineage(codes.rows.withColumn("label_key", key))
    sums = cut_lineage(rows.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    count, total, width = sums.agg(F.count(F.lit(1)), F.sum("n"), F.max(F.octet_length("label_key"))).first()
    least = max(int((total or 0) * hot_share(rows.sparkSession)), 1)
    hot = tuple(r["label_key"] for r in sums.filter(F.col("n") >= least).select("label_key").collect())
    return join_back(rows, sums.drop("n"), "label_key", KeyProfile(count, width or 0, hot), ["id", "code"]).drop("label_key")
