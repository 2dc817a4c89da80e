"""Mean silhouette of labelled rows.

Squared Euclidean distances fold into per-label sums, so that metric is linear
in the rows. The plain Euclidean mean needs every distance; it is computed
between blocks of distinct vectors by matrix products, each pair of blocks meeting
once and yielding sums per vector and label, never the distances themselves. Its work
grows with the square of the distinct vectors, so it is for tables of moderate size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.session import cut_lineage

#: Rows of a block: at least, and at most while its vectors and sums hold no more than so many numbers.
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCK_NUMBERS = 4096, 16_384, 1 << 22
MOST_TASKS = 4096
#: Share of the norms below which a squared distance is not taken from them.
CANCELLED = 1e-6
MAX_LABELS = 4096


def silhouette(
    df: DataFrame, features: list[str], label: str, metric: str = "squared", max_labels: int = MAX_LABELS
) -> float | None:
    """Mean silhouette over all rows; None with fewer than two labels."""
    return silhouettes(df, features, [label], metric, max_labels)[label]


def silhouettes(
    df: DataFrame, features: list[str], labels: list[str], metric: str = "squared", max_labels: int = MAX_LABELS
) -> dict[str, float | None]:
    """Mean silhouette of each label column, all in the same passes.

    Per-label sums visit the driver; ``max_labels`` per column bounds them and may
    be raised with the driver's memory.
    """
    if metric not in ("squared", "euclidean"):
        raise ValueError(f"metric must be 'squared' or 'euclidean', not {metric!r}")
    vectors = [F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)]
    narrow = df.select(*vectors, *[F.col(c).cast("long").alias(f"_l{i}") for i, c in enumerate(labels)])
    sizes = _label_sizes(narrow, len(labels), max_labels)
    fn = _squared if metric == "squared" else _euclidean
    usable = {i: s for i, s in sizes.items() if len(s) > 1}
    means = fn(narrow, len(features), usable) if usable else {}
    return {c: means.get(i) for i, c in enumerate(labels)}


def _label_sizes(df: DataFrame, n: int, most: int) -> dict[int, dict[int, int]]:
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_l{i}").alias("l")) for i in range(n)])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.c", "p.l").count().limit(n * most + 1).collect()
    if len(counts) > n * most:
        raise ValueError(f"more than {most} labels per column; raise max_labels")
    out: dict[int, dict[int, int]] = {i: {} for i in range(n)}
    for row in sorted(counts, key=lambda r: (r["c"], r["l"])):
        out[row["c"]][row["l"]] = row["count"]
    return out


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names])


def _score(own: np.ndarray, total: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouettes from (rows, labels) distance totals; ``own`` is the row's label position."""
    line = np.arange(len(own))
    n_own = sizes[own]
    a = total[line, own] / np.maximum(n_own - 1, 1)
    mean = total / sizes
    mean[line, own] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    s = np.where(top > 0, (b - a) / np.where(top > 0, top, 1.0), 0.0)
    return np.where(n_own > 1, s, 0.0)


def _squared(df: DataFrame, width: int, sizes: dict[int, dict[int, int]]) -> dict[int, float]:
    """Two passes: sums per label, then the silhouettes from those sums."""
    names = [f"_f{i}" for i in range(width)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch, names)
            ext = np.column_stack([x, (x * x).sum(axis=1)])
            for c in sizes:
                own = _matrix(batch, [f"_l{c}"])[:, 0]
                for value in np.unique(own):
                    key = (c, int(value))
                    sums[key] = sums.get(key, 0.0) + ext[own == value].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in sums], pa.int32()),
                    pa.array([k[1] for k in sums], pa.int64()),
                    pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())),
                ],
                names=["c", "l", "s"],
            )

    folded = df.mapInArrow(fold, "c int, l long, s array<double>")
    rows = (
        folded.select("c", "l", F.posexplode("s").alias("i", "v"))
        .groupBy("c", "l", "i").agg(F.sum("v").alias("v")).collect()
    )
    sums = {c: np.zeros((len(s), width + 1)) for c, s in sizes.items()}
    place = {c: {l: j for j, l in enumerate(s)} for c, s in sizes.items()}
    for r in rows:
        sums[r["c"]][place[r["c"]][r["l"]], r["i"]] = r["v"]
    counts = {c: np.array(list(s.values()), dtype=float) for c, s in sizes.items()}
    order = {c: np.array(list(s)) for c, s in sizes.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_of = dict.fromkeys(sizes, 0.0)
        for batch in batches:
            x = _matrix(batch, names)
            norm = (x * x).sum(axis=1)[:, None]
            for c in sizes:
                own = np.searchsorted(order[c], _matrix(batch, [f"_l{c}"])[:, 0])
                total = counts[c] * norm - 2.0 * x @ sums[c][:, :width].T + sums[c][:, width]
                sums_of[c] += _score(own, np.maximum(total, 0.0), counts[c]).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums_of), pa.int32()), pa.array(list(sums_of.values()), pa.float64())], names=["c", "s"]
        )

    parts = df.mapInArrow(score, "c int, s double").groupBy("c").agg(F.sum("s").alias("s")).collect()
    return {r["c"]: float(r["s"] / counts[r["c"]].sum()) for r in parts}


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all of ``y``, by one matrix product.

    A squared distance that is small beside the norms has lost digits to their
    difference; those are taken from the rows themselves.
    """
    x_norm, y_norm = (x * x).sum(axis=1), (y * y).sum(axis=1)
    gap = x @ y.T
    gap *= -2.0
    gap += x_norm[:, None]
    gap += y_norm[None, :]
    i, j = np.nonzero(gap < CANCELLED * (x_norm.max() + y_norm.max()))
    for at in range(0, len(i), 65_536):
        here = slice(at, at + 65_536)
        gap[i[here], j[here]] = ((x[i[here]] - y[j[here]]) ** 2).sum(axis=1)
    return np.sqrt(gap, out=gap)


def _euclidean(df: DataFrame, width: int, sizes: dict[int, dict[int, int]]) -> dict[int, float]:
    """Distinct vectors lie in packed blocks; each pair of blocks meets once and gives totals for the rows of both."""
    names = [f"_f{i}" for i in range(width)]
    tags = [f"_l{c}" for c in sizes]
    order = {c: np.array(list(s)) for c, s in sizes.items()}
    counts = {c: np.array(list(s.values()), dtype=float) for c, s in sizes.items()}
    slots = sum(len(o) for o in order.values())
    distinct = cut_lineage(df.groupBy(*names, *tags).agg(F.count(F.lit(1)).alias("_w")))
    told = distinct.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    middle = np.array([told[c] or 0.0 for c in names])
    most = max(min(MOST_BLOCK_ROWS, BLOCK_NUMBERS // max(slots, width)), 256)
    blocks = max(1, math.ceil(told["n"] / min(max(BLOCK_ROWS, told["n"] // 24), most)))

    def pack(table: pa.Table) -> pa.Table:
        x = np.column_stack([table[c].to_numpy() for c in names]) - middle
        labels = np.vstack([table[c].to_numpy() for c in tags]).astype("<i8")
        return pa.table({
            "_b": pa.array([table["_b"][0].as_py()], pa.int32()), "_x": pa.array([x.astype("<f8").tobytes()], pa.binary()),
            "_l": pa.array([labels.tobytes()], pa.binary()), "_w": pa.array([table["_w"].to_numpy().astype("<i8").tobytes()], pa.binary()),
        })

    block = F.pmod(F.xxhash64(*names, *tags), F.lit(blocks)).cast("int")
    packed = cut_lineage(distinct.withColumn("_b", block).groupBy("_b").applyInArrow(pack, "_b int, _x binary, _l binary, _w binary"))

    def unpacked(x: bytes, labels: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The vectors, and their weights in the columns of their labels."""
        weights = np.frombuffer(w, "<i8").astype(float)
        share, at = np.zeros((len(weights), slots)), 0
        for c, own in zip(sizes, np.frombuffer(labels, "<i8").reshape(len(tags), len(weights))):
            share[np.arange(len(weights)), at + np.searchsorted(order[c], own)] = weights
            at += len(order[c])
        return np.frombuffer(x, "<f8").reshape(len(weights), width), share

    def totals(table: pa.Table) -> pa.Table:
        """Totals of distances by label, for the rows of one or both blocks."""
        table = table.sort_by("_b")
        own, other = table.slice(0, 1).to_pylist()[0], table.slice(table.num_rows - 1, 1).to_pylist()[0]
        (x, x_share), (y, y_share) = (unpacked(r["_x"], r["_l"], r["_w"]) for r in (own, other))
        mine, theirs = np.empty((len(x), slots)), np.zeros((len(y), slots))
        same = own["_i"] == own["_j"]
        for i in range(0, len(x), 256):
            gap = _distances(x[i:i + 256], y)
            mine[i:i + 256] = gap @ y_share
            if not same:
                theirs += gap.T @ x_share[i:i + 256]
        found = [(own["_b"], mine)] + ([] if same else [(other["_b"], theirs)])
        return pa.table({
            "_b": pa.array([b for b, _ in found], pa.int32()), "_t": pa.array([t.astype("<f8").tobytes() for _, t in found], pa.binary()),
        })

    # block b goes to every pair (i, j), i <= j, that it is part of; pairs with a block that has no rows have nothing to give
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    copies = packed.withColumn("_o", other).select("*", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))
    present = packed.select(F.col("_b").alias("_o"))
    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    dealt = copies.join(F.broadcast(present), "_o").drop("_o").repartition(tasks, "_i", "_j")
    summed = dealt.groupBy("_i", "_j").applyInArrow(totals, "_b int, _t binary")

    def score(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.filter(pc.is_valid(table["_w"])).to_pylist()[0]
        weight = np.frombuffer(rows["_w"], "<i8").astype(float)
        total = np.zeros((len(weight), slots))
        for t in table["_t"]:
            if t.is_valid:
                total += np.frombuffer(t.as_buffer(), "<f8").reshape(len(weight), slots)
        sums_of, at = [], 0
        for c, own in zip(sizes, np.frombuffer(rows["_l"], "<i8").reshape(len(tags), len(weight))):
            k = len(order[c])
            sums_of.append(float((_score(np.searchsorted(order[c], own), total[:, at:at + k], counts[c]) * weight).sum()))
            at += k
        return pa.table({"c": pa.array(list(sizes), pa.int32()), "s": pa.array(sums_of, pa.float64())})

    none = F.lit(None).cast("binary")
    told = summed.select("_b", "_t", none.alias("_l"), none.alias("_w")).unionByName(packed.select("_b", none.alias("_t"), "_l", "_w"))
    found = told.groupBy("_b").applyInArrow(score, "c int, s double").groupBy("c").agg(F.sum("s").alias("s")).collect()
    return {r["c"]: float(r["s"] / counts[r["c"]].sum()) for r in found}
