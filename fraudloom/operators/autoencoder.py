"""Reconstruction-error models: a dense autoencoder and a PCA baseline.

Training is data-parallel and synchronous. Rows are put in a fixed random order and cut
into slots of ``SLOT`` rows, each packed into one row of a written table. In every epoch
each slot passes its mini-batches through Adam from the shared weights; the slots'
weights and moments, weighted by rows, are added up in a tree whose branches are given
by the slots' numbers, and their mean is what the next epoch starts from. Slots follow
from the rows alone, so the model is the same, to the last bit, under any partitioning
and on any cluster, while the tasks of an epoch grow with the table and get as many
slots each. A table of one slot
is trained exactly as by a single process. The driver gets at most ``FOLD`` partial sums
per epoch, never rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.operators.flags import validation_split
from fraudloom.operators.numbering import number_rows
from fraudloom.schemas import KEY_COLS
from fraudloom.session import a_task_per_file, cut_lineage

#: Rows of a slot: what one task trains on by itself within an epoch.
SLOT = 8192
#: Partial sums that are added up at one place.
FOLD = 64
#: Slots of a task that take their steps side by side.
STACK = 16
#: Steps whose rows are laid out at once.
PIECE = 4
#: How a slot's rows are packed: every epoch hands them from a file to a Python worker.
CODEC = "zstd"
#: Bytes of a file of the slot table, before compression: less than Spark would split.
FILE_BYTES = 100 << 20


@dataclass(frozen=True)
class Network:
    """Layer widths and training settings.

    ``dropout`` maps a hidden layer to its rate, ``l2`` to its weight penalty.
    """

    hidden: tuple[int, ...] = (32, 16, 8, 16, 32)
    output: str = "sigmoid"
    dropout: dict[int, float] = field(default_factory=dict)
    l2: dict[int, float] = field(default_factory=dict)
    epochs: int = 50
    batch: int = 32
    validation: float = 0.0
    patience: int | None = None
    min_delta: float = 0.0
    restore_best: bool = False
    rate: float = 0.001


# The three trained settings.
PLAIN = Network()
REGULARISED = Network(
    dropout={0: 0.2, 1: 0.2, 3: 0.2}, l2={0: 0.01, 1: 0.01, 2: 0.01}, epochs=100, validation=0.2, patience=10
)
STANDALONE = Network(
    hidden=(12, 24, 12, 4, 12, 24, 12), dropout={1: 0.2, 5: 0.2}, epochs=100, batch=64,
    validation=0.2, patience=10, min_delta=0.001, restore_best=True,
)


@dataclass(frozen=True)
class Autoencoder:
    features: list[str]
    network: Network
    weights: np.ndarray
    history: list[dict]

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        net = dict(self.network.__dict__, hidden=list(self.network.hidden))
        header = json.dumps({"features": self.features, "network": net, "history": self.history})
        row = [(header, self.weights.tolist())]
        spark.createDataFrame(row, "header string, weights array<double>").coalesce(1).write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Autoencoder:
        row = spark.read.parquet(path).first()
        h = json.loads(row["header"])
        net = h["network"]
        net["hidden"] = tuple(net["hidden"])
        for part in ("dropout", "l2"):
            net[part] = {int(k): v for k, v in net[part].items()}
        return Autoencoder(h["features"], Network(**net), np.array(row["weights"]), h["history"])


def _shapes(width: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, width]
    return list(zip(sizes, sizes[1:]))


def _unpack(flat: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's weights and biases inside the flat vector."""
    out, at = [], 0
    for n, m in shapes:
        out.append((flat[at:at + n * m].reshape(n, m), flat[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def _start(shapes: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Uniform weights scaled by layer widths, zero biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for n, m in shapes:
        bound = np.sqrt(6.0 / (n + m))
        parts += [rng.uniform(-bound, bound, n * m), np.zeros(m)]
    return np.concatenate(parts)


def _forward(layers, x: np.ndarray, net: Network, rng: np.random.Generator | None = None):
    """Activations of every layer and the dropout masks used."""
    acts, masks = [x], {}
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        if i < len(layers) - 1:
            z = np.maximum(z, 0.0)
            if rng is not None and net.dropout.get(i):
                masks[i] = (rng.random(z.shape) >= net.dropout[i]) / (1.0 - net.dropout[i])
                z = z * masks[i]
        elif net.output == "sigmoid":
            z = 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))
        acts.append(z)
    return acts, masks


def _gradient(flat: np.ndarray, shapes, x: np.ndarray, net: Network, rng) -> tuple[np.ndarray, float]:
    layers = _unpack(flat, shapes)
    acts, masks = _forward(layers, x, net, rng)
    gap = acts[-1] - x
    loss = float((gap * gap).mean())
    delta = 2.0 * gap / gap.size
    if net.output == "sigmoid":
        delta = delta * acts[-1] * (1.0 - acts[-1])
    grad = np.empty_like(flat)
    slots = _unpack(grad, shapes)
    for i in range(len(layers) - 1, -1, -1):
        w = layers[i][0]
        slots[i][0][...] = acts[i].T @ delta
        slots[i][1][...] = delta.sum(axis=0)
        penalty = net.l2.get(i)
        if penalty:
            slots[i][0][...] += 2.0 * penalty * w
            loss += penalty * float((w * w).sum())
        if i:
            delta = (delta @ w.T) * (acts[i] > 0)
            if i - 1 in masks:
                delta = delta * masks[i - 1]
    return grad, loss


def _layered(flat: np.ndarray, shapes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's weights (stack, n, m) and biases (stack, m) inside stacked flat vectors."""
    out, at = [], 0
    for n, m in shapes:
        out.append((flat[:, at:at + n * m].reshape(len(flat), n, m), flat[:, at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def _train(states: np.ndarray, step: int, xs: list[np.ndarray], net: Network, shapes, rngs) -> list[tuple[int, float]]:
    """Mini-batches of every table of ``xs`` through Adam from its own state, in place: (steps, sum of row losses) each.

    The tables take their steps side by side, as one small product costs little more
    than its call; each gets what it would get by itself. Full batches come first, by
    all tables that still have one, then each one's rest.
    """
    if len(xs) > 1 and 1 in (m for pair in shapes for m in pair):
        # products with single columns round otherwise where the column lies in strides
        return [_train(states[i:i + 1], step, [x], net, shapes, [rng])[0] for i, (x, rng) in enumerate(zip(xs, rngs))]
    full = [len(x) // net.batch for x in xs]
    # tables of most batches stand first, so that those still at work are a slice
    ranks = sorted(range(len(xs)), key=lambda i: -full[i])
    ranked = states[ranks].reshape(len(xs), 3, -1).transpose(1, 0, 2).copy()
    total, done, stack = np.zeros(len(xs)), 0, None
    while at_work := [i for i in ranks if full[i] > done]:
        count = len(at_work)
        if stack is None or len(stack.weights) != count:
            stack = _Stack(ranked[:, :count], net.batch, PIECE, net, shapes)
        steps = min(PIECE, full[at_work[-1]] - done)
        first, last = done * net.batch, (done + steps) * net.batch
        stack.lay([xs[i][first:last] for i in at_work], [rngs[i] for i in at_work], steps)
        for at in range(steps):
            done += 1
            total[:count] += stack.step(at, step + done) * net.batch
    told = [(0, 0.0)] * len(xs)
    for place, i in enumerate(ranks):
        steps, rest = full[i], xs[i][full[i] * net.batch:]
        if len(rest):
            steps += 1
            stack = _Stack(ranked[:, place:place + 1], len(rest), 1, net, shapes)
            stack.lay([rest], [rngs[i]], 1)
            total[place] += stack.step(0, step + steps)[0] * len(rest)
        told[i] = steps, float(total[place])
    states[ranks] = ranked.transpose(1, 0, 2).reshape(states.shape)
    return told


class _Stack:
    """Tables that take their steps side by side from ``states`` (3, stack, size), ``n`` rows of each at once.

    Rows come first in all arrays (n, stack, m), so that what is done alike for all
    tables runs over long stretches; products take each table's rows through strides.
    Arrays and views are made once and used by every step.
    """

    def __init__(self, states: np.ndarray, n: int, pieces: int, net: Network, shapes):
        self.n, self.net, (_, count, size), width = n, net, states.shape, shapes[0][0]
        self.weights, self.first, self.second = states
        self.grad, self.move, self.root = np.empty((3, count, size))
        self.layers, self.slopes = _layered(self.weights, shapes), _layered(self.grad, shapes)
        self.dropped = [(i, shapes[i][1], net.dropout[i]) for i in range(len(shapes) - 1) if net.dropout.get(i)]
        self.x = np.empty((pieces, n, count, width))
        self.masks = {i: np.empty((pieces, n, count, m)) for i, m, _ in self.dropped}
        self.kept = {i: np.empty((pieces, n, count, m), bool) for i, m, _ in self.dropped}
        self.drawn = np.empty(pieces * n * sum(m for _, m, _ in self.dropped))
        self.gap, self.zeros = np.empty((n, count, width)), [np.zeros((n, count, m)) for _, m in shapes]
        self.acts, self.deltas = ([np.empty((n, count, m)) for _, m in shapes] for _ in range(2))
        self.live = [np.empty((n, count, m), bool) for _, m in shapes]
        self.sums = [np.empty(count * m) for _, m in shapes]
        # the same arrays, table by table and row by row
        self.table_acts, self.table_deltas = ([z.transpose(1, 0, 2) for z in made] for made in (self.acts, self.deltas))
        self.turned_acts = [z.transpose(1, 2, 0) for z in self.acts]
        self.row_acts, self.row_deltas = ([z.reshape(n, -1) for z in made] for made in (self.acts, self.deltas))
        self.turned_weights = [w.transpose(0, 2, 1) for w, _ in self.layers]

    def lay(self, xs: list[np.ndarray], rngs, steps: int) -> None:
        """The rows of the next ``steps`` steps, and what dropout leaves of them."""
        n = self.n
        np.stack([x.reshape(steps, n, -1) for x in xs], axis=2, out=self.x[:steps])
        if not self.dropped:
            return
        drawn = self.drawn.reshape(len(self.x), -1)[:steps]
        for place, rng in enumerate(rngs):
            rng.random(out=drawn)
            taken = 0
            for i, m, rate in self.dropped:
                np.greater_equal(drawn[:, taken:taken + n * m].reshape(steps, n, m), rate, out=self.kept[i][:steps, :, place])
                taken += n * m
        for i, _, rate in self.dropped:
            np.divide(self.kept[i][:steps], 1.0 - rate, out=self.masks[i][:steps])

    def step(self, piece: int, at: int) -> np.ndarray:
        """One step of Adam, number ``at``, on the rows laid at ``piece``: the losses."""
        n, net, last, x = self.n, self.net, len(self.layers) - 1, self.x[piece]
        masks = {i: m[piece] for i, m in self.masks.items()}
        given = x.transpose(1, 0, 2)
        for i, (w, b) in enumerate(self.layers):
            z = self.acts[i]
            np.matmul(given, w, out=self.table_acts[i])
            self.row_acts[i] += b.reshape(-1)
            if i < last:
                np.maximum(z, self.zeros[i], out=z)
                if i in masks:
                    z *= masks[i]
            elif net.output == "sigmoid":
                np.maximum(z, -60.0, out=z)
                np.minimum(z, 60.0, out=z)
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1.0
                np.divide(1.0, z, out=z)
            given = self.table_acts[i]
        y, gap, delta = self.acts[last], self.gap, self.deltas[last]
        per = n * x.shape[2]
        np.subtract(y, x, out=gap)
        np.multiply(gap, gap, out=delta)
        loss = np.add.reduce(self.table_deltas[last].reshape(-1, per), axis=1) / per
        np.multiply(gap, 2.0, out=delta)
        delta /= per
        if net.output == "sigmoid":
            delta *= y
            np.subtract(1.0, y, out=gap)
            delta *= gap
        for i in range(last, -1, -1):
            slope, summed = self.slopes[i]
            np.matmul(self.turned_acts[i - 1] if i else x.transpose(1, 2, 0), self.table_deltas[i], out=slope)
            np.add.reduce(self.row_deltas[i], axis=0, out=self.sums[i])
            summed[...] = self.sums[i].reshape(summed.shape)
            penalty = net.l2.get(i)
            if penalty:
                w = self.layers[i][0]
                slope += 2.0 * penalty * w
                loss += [penalty * float((one * one).sum()) for one in w]
            if i:
                delta, live = self.deltas[i - 1], self.live[i - 1]
                np.matmul(self.table_deltas[i], self.turned_weights[i], out=self.table_deltas[i - 1])
                np.greater(self.acts[i - 1], self.zeros[i - 1], out=live)
                delta *= live
                if i - 1 in masks:
                    delta *= masks[i - 1]
        first, second, grad, move, root = self.first, self.second, self.grad, self.move, self.root
        first *= 0.9
        np.multiply(grad, 0.1, out=move)
        first += move
        second *= 0.999
        np.multiply(grad, 0.001, out=move)
        move *= grad
        second += move
        np.multiply(first, net.rate * np.sqrt(1.0 - 0.999**at) / (1.0 - 0.9**at), out=move)
        np.sqrt(second, out=root)
        root += 1e-7
        move /= root
        self.weights -= move
        return loss


def _slots(rows: DataFrame, features: list[str], key_cols: list[str], seed: int, slot: int) -> tuple[DataFrame, int]:
    """The written slots (slot, held, x) and how many there are.

    Rows are ordered by a hash of their keys, then by their features, so that only
    rows that are the same in all that training sees could change places.
    """
    names = [f"_f{i}" for i in range(len(features))]
    narrow = rows.select(
        F.xxhash64(F.lit(seed), *key_cols).alias("_order"), F.col("is_validation").alias("_held"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)], F.monotonically_increasing_id().alias("_row"),
    )
    placed = number_rows(narrow, ["_order", "_held", *names, "_row"], "_place")
    count = -(-placed.count() // slot)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        x = np.column_stack([table[n].to_numpy() for n in names])
        return pa.table({
            "slot": pa.array([int(table["_place"][0].as_py()) // slot], pa.int64()),
            "held": pa.array([table["_held"].to_numpy().astype(np.uint8).tobytes()], pa.binary()),
            "x": pa.array([pa.compress(x.astype("<f8").tobytes(), codec=CODEC, asbytes=True)], pa.binary()),
        })

    packed = placed.select("_place", "_held", *names).groupBy(F.floor(F.col("_place") / slot)).applyInArrow(pack, "slot long, held binary, x binary")
    files = _files(count, slot * (8 * len(features) + 1), rows.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(packed.repartitionById(files, (F.col("slot") % files).cast("int"))), count


def _files(count: int, size: int, cores: int) -> int:
    """Files for ``count`` slots of ``size`` bytes: as many for each core, so that an epoch's tasks are of one length."""
    waves = -(-count * size // (cores * FILE_BYTES))
    return max(min(count, cores * waves), 1)


def autoencoder_fit(
    df: DataFrame, features: list[str], network: Network = PLAIN, seed: int = 42,
    key_cols: list[str] | None = None, slot: int = SLOT,
) -> Autoencoder:
    """Train on the complete rows of ``df``. Another ``slot`` gives another, equally valid, model."""
    key_cols = key_cols or KEY_COLS
    net, width = network, len(features)
    shapes = _shapes(width, net.hidden)
    rows = validation_split(df.dropna(subset=features), key_cols, net.validation, seed + 1)
    slots, count = _slots(rows, features, key_cols, seed, slot)
    context = df.sparkSession.sparkContext
    # weights, first and second moments, and the step they were taken at
    state = np.concatenate([_start(shapes, seed), np.zeros(2 * sum(n * m + m for n, m in shapes))])
    step, history, best, best_weights, waited = 0, [], np.inf, None, 0
    size = len(state) // 3
    for epoch in range(net.epochs + 1):
        last = epoch == net.epochs
        if last and epoch and not total["v_n"]:
            break  # no rows to validate the last weights on
        shared = context.broadcast((state, step))
        parts = slots.mapInArrow(_epoch(shared, shapes, net, seed, epoch, width, learn=not last), _SUMS)
        with a_task_per_file(df.sparkSession):
            total = _added_up(parts, count)
        shared.destroy()
        if epoch and total["v_n"]:
            # validation ran on the weights this epoch started from
            value = total["v_loss"] / total["v_n"]
            history[-1]["val_loss"] = value
            if value < best - net.min_delta:
                best, waited, best_weights = value, 0, state[:size].copy()
            else:
                waited += 1
            if net.patience is not None and waited >= net.patience:
                break
        if last or not total["n"]:
            break
        state = total["state"] / total["n"]
        step += total["steps"]
        history.append({"epoch": epoch, "loss": total["loss"] / total["n"], "val_loss": None})
    weights = best_weights if net.restore_best and best_weights is not None else state[:size]
    return Autoencoder(list(features), net, weights, history)


#: Sums over slots: learned and held rows, losses, most steps, and states times learned rows.
_SUMS = "slot long, n long, v_n long, steps long, loss double, v_loss double, state binary"


def _sum_of(rows: list[dict]) -> dict:
    """One row for several, added in the order of their slots."""
    rows = sorted(rows, key=lambda r: r["slot"])
    out = {c: sum(r[c] for r in rows) for c in ("n", "v_n", "loss", "v_loss")}
    state = np.frombuffer(rows[0]["state"], "<f8").copy()
    for r in rows[1:]:
        state += np.frombuffer(r["state"], "<f8")
    return out | {"slot": rows[0]["slot"], "steps": max(r["steps"] for r in rows), "state": state.tobytes()}


def _table_of(rows: list[dict]) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in _SUMS.split(", ")]
    return pa.Table.from_pylist(rows, schema=pa.schema([(n, kinds[k]) for n, k in fields]))


def _added_up(parts: DataFrame, count: int) -> dict:
    """The sum of all slots' rows: branches of ``FOLD`` are added on the executors until that many are left."""
    span = 1
    while count > FOLD:
        span, count = span * FOLD, -(-count // FOLD)
        parts = parts.groupBy(F.floor(F.col("slot") / span)).applyInArrow(lambda t: _table_of([_sum_of(t.to_pylist())]), _SUMS)
    rows = [r.asDict() for r in parts.collect()]
    if not rows:
        return {"n": 0, "v_n": 0, "steps": 0}
    out = _sum_of(rows)
    return out | {"state": np.frombuffer(out["state"], "<f8")}


def _epoch(shared, shapes, net: Network, seed: int, epoch: int, width: int, learn: bool):
    """Each slot's pass: validation loss of the given weights, then training from them."""

    def passed(slots: list[dict]) -> Iterator[dict]:
        state, step = shared.value
        states, xs, rngs, out = np.tile(state, (len(slots), 1)), [], [], []
        for r in slots:
            held = np.frombuffer(r["held"], np.uint8).astype(bool)
            x = pa.decompress(r["x"], len(held) * width * 8, codec=CODEC)
            x = np.frombuffer(x, "<f8").reshape(len(held), width)
            v_n, v_loss = int(held.sum()), 0.0
            if v_n:
                acts, _ = _forward(_unpack(state[:len(state) // 3], shapes), x[held], net)
                v_loss = float(((acts[-1] - x[held]) ** 2).mean(axis=1).sum())
            rng, learned = np.random.default_rng([seed, epoch, r["slot"]]), np.flatnonzero(~held)
            if learn:
                xs.append(x[learned[rng.permutation(len(learned))]])
                rngs.append(rng)
            out.append({"slot": r["slot"], "n": len(learned), "v_n": v_n, "v_loss": v_loss})
        told = _train(states, step, xs, net, shapes, rngs) if learn else [(0, 0.0)] * len(out)
        for row, own, (steps, loss) in zip(out, states, told):
            yield row | {"steps": steps, "loss": loss, "state": (own * row["n"]).astype("<f8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.num_rows
            for stacks in range(-(-rest // STACK), 0, -1):  # of about as many slots each
                some = batch.slice(batch.num_rows - rest, -(-rest // stacks))
                rest -= some.num_rows
                yield from _table_of(list(passed(some.to_pylist()))).to_batches()

    return run


def _map_rows(df: DataFrame, keep: list[str], features: list[str], out: str, fn) -> DataFrame:
    """``keep`` columns and ``fn`` of the feature matrix; null where a feature is missing."""
    n_keep, width = len(keep), len(features)
    kept = df.select(*keep).schema.fields
    narrow = df.select(*keep, *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n_keep + i).to_numpy(zero_copy_only=False) for i in range(width)])
            x = x.astype(float)
            values = pa.array(fn(x), mask=np.isnan(x).any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n_keep)], values], names=[*keep, out]
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` double"])
    return narrow.mapInArrow(run, schema)


def autoencoder_error(
    model: Autoencoder, df: DataFrame, keep: list[str] | None = None, out: str = "Autoencoder_Error"
) -> DataFrame:
    """Mean squared reconstruction error per row; higher is stranger."""
    shapes, net = _shapes(len(model.features), model.network.hidden), model.network
    shared = df.sparkSession.sparkContext.broadcast(model.weights)

    def error(x: np.ndarray) -> np.ndarray:
        layers = _unpack(shared.value, shapes)
        parts = [
            ((_forward(layers, x[i:i + 8192], net)[0][-1] - x[i:i + 8192]) ** 2).mean(axis=1)
            for i in range(0, len(x), 8192)
        ]
        return np.concatenate(parts) if parts else np.zeros(0)

    return _map_rows(df, keep or KEY_COLS, model.features, out, error)


@dataclass(frozen=True)
class PcaModel:
    """Principal directions (width x k) and the feature means."""

    features: list[str]
    mean: np.ndarray
    directions: np.ndarray


def pca_fit(df: DataFrame, features: list[str], k: int = 8) -> PcaModel:
    clean = df.dropna(subset=features)
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(clean).select("_x")
    directions = PCA(k=min(k, len(features)), inputCol="_x", outputCol="_p").fit(rows).pc.toArray()
    mean = clean.agg(*[F.avg(c).alias(c) for c in features]).first()
    return PcaModel(list(features), np.array([mean[c] for c in features]), directions)


def pca_error(model: PcaModel, df: DataFrame, keep: list[str] | None = None, out: str = "Autoencoder_Error") -> DataFrame:
    mean, directions = model.mean, model.directions

    def error(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return ((centred - centred @ directions @ directions.T) ** 2).mean(axis=1)

    return _map_rows(df, keep or KEY_COLS, model.features, out, error)


def reconstruction_error(df: DataFrame, actual: str, rebuilt: str, out: str = "error") -> DataFrame:
    """Mean squared difference of two array columns."""
    squares = F.zip_with(actual, rebuilt, lambda x, y: (x - y) * (x - y))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(out, total / F.size(actual))


def training_metrics(model: Autoencoder, f1: float, threshold: float, spark: SparkSession) -> DataFrame:
    """One row: last losses, epochs run, F1 and the threshold."""
    done = model.history
    last_val = next((h["val_loss"] for h in reversed(done) if h["val_loss"] is not None), None)
    row = (len(done), done[-1]["loss"] if done else None, last_val, float(f1), float(threshold))
    return spark.createDataFrame(
        [row], "epochs int, final_loss double, val_loss double, f1_score double, threshold double"
    )
