"""Deciding pairs of dense cells without comparing their vectors one by one.

Cells of many vectors are split into k-d trees: a node is halved at the middle of its
widest dimension until it holds at most ``LEAF`` vectors. A question between a vector
(or a cell) and a cell goes down the tree with tight bounds at every node: a node that
lies within the radius as a whole answers for all its vectors, one beyond it is
dropped, and a question that has its answer is not asked further down. Vectors are
compared only between leaves that bounds never decided.

Trees grow level by level, one aggregation each, and only cells that are still too large
take part, so without dense cells there is nothing but the cells themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.session import cut_lineage

#: Vectors of a node that is not split.
LEAF = 64
#: Levels of a tree; nodes this deep are narrower than their cell by a factor beyond double precision.
DEEPEST = 60
#: Share by which bounds must miss the radius to decide alone; closer ones are left to the vectors.
SLACK = 1e-9


def whole(eps: float, far: str = "far") -> Column:
    """All vectors of both sides lie within ``eps``."""
    return F.col(far) <= eps * eps * (1 - SLACK)


def undecided(eps: float, near: str = "near", far: str = "far") -> Column:
    """Bounds do not decide; vectors must be compared."""
    return ~whole(eps, far) & (F.col(near) <= eps * eps * (1 + SLACK))


def _total(terms: list[Column]) -> Column:
    return reduce(add, terms)


@dataclass(frozen=True)
class Trees:
    """``paths`` (v, path): the nodes from a vector's cell down to its leaf; cells that are not split have no rows."""

    paths: DataFrame | None
    levels: int


def grow(vectors: DataFrame, names: list[str], leaf: int = LEAF) -> Trees:
    """Trees of the cells with more than ``leaf`` of the ``vectors`` (v, cell and coordinates)."""
    large = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf).select("cell")
    inside = cut_lineage(vectors.join(large, "cell").select("v", *names, F.col("cell").alias("node"), F.array("cell").alias("path")))
    if inside.isEmpty():
        return Trees(None, 0)
    done, level = [], 0
    while level < DEEPEST:
        spans = [F.max(c) - F.min(c) for c in names]
        widest = F.greatest(*spans, F.lit(0.0)) if len(names) > 1 else spans[0]
        middles = [(F.max(c) + F.min(c)) / 2 for c in names]
        axis = reduce(lambda rest, i: F.when(spans[i] == widest, i).otherwise(rest), reversed(range(len(names))), F.lit(0))
        cuts = inside.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), axis.alias("axis"), F.array(*middles).alias("middles"), widest.alias("span")
        ).filter((F.col("n") > leaf) & (F.col("span") > 0)).select("node", "axis", F.get("middles", F.col("axis")).alias("middle"))
        cuts = cut_lineage(cuts)
        if cuts.isEmpty():
            break
        level += 1
        done.append(inside.join(cuts, "node", "left_anti").select("v", "path"))
        child = F.concat("node", F.when(F.get(F.array(*names), F.col("axis")) > F.col("middle"), ":1").otherwise(":0"))
        inside = cut_lineage(inside.join(cuts, "node").withColumn("node", child).select("v", *names, "node", F.concat("path", F.array("node")).alias("path")))
    done.append(inside.select("v", "path"))
    return Trees(cut_lineage(reduce(DataFrame.unionByName, done)), level)


def placed(vectors: DataFrame, trees: Trees) -> DataFrame:
    """``vectors`` with their path."""
    if trees.paths is None:
        return vectors.withColumn("path", F.array("cell"))
    return vectors.join(trees.paths, "v", "left").withColumn("path", F.coalesce("path", F.array("cell")))


def _leaves(on_path: DataFrame) -> DataFrame:
    return on_path.withColumn("node", F.element_at("path", -1)).drop("path")


def _children(on_path: DataFrame, names: list[str], values: list[Column], below_leaves: bool) -> DataFrame:
    """(parent, node, ends, lo*, hi*, values): every node under its parent; leaves under themselves if asked."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(
        F.element_at("path", i).alias("parent"), F.element_at("path", i + 1).alias("node"), (i + 1 == F.size("path")).alias("ends")
    ))
    steps = F.when(F.size("path") > 1, steps).otherwise(F.array().cast("array<struct<parent:string,node:string,ends:boolean>>"))
    if below_leaves:
        last = F.element_at("path", -1)
        steps = F.concat(steps, F.array(F.struct(last.alias("parent"), last.alias("node"), F.lit(True).alias("ends"))))
    bounds = [f(c).alias(f"{n}{i}") for i, c in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max))]
    long = on_path.withColumn("step", F.explode(steps))
    return cut_lineage(long.groupBy("step.parent", "step.node").agg(F.max("step.ends").alias("ends"), *bounds, *values))


@dataclass(frozen=True)
class Question:
    """``combine`` (sum, max or min) of ``value`` over all vectors within ``eps``.

    The answer is final once it reaches ``enough``.
    """

    eps: float
    value: str
    combine: str
    enough: float | None = None

    def over(self, c: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.combine](c)


def ask(
    seekers: DataFrame, pairs: DataFrame, others: DataFrame, trees: Trees, names: list[str], questions: list[Question],
    known: DataFrame | None = None,
) -> DataFrame:
    """(v, answer_0, ...) for seekers whose answers the ``pairs`` of cells leave open.

    ``seekers`` has v, cell and coordinates; ``pairs`` a, b, near and far;
    ``others`` v, cell, coordinates and the values asked for. Pairs that are
    decided as wholes are not counted here. ``known`` (v, answer_0, ...) holds what
    is known before, and only serves to stop early.
    """
    marks = [f"open_{q}" for q in range(len(questions))]
    answers = [f"answer_{q}" for q in range(len(questions))]
    any_open = reduce(lambda a, b: a | b, [F.col(m) for m in marks])
    started = pairs.select("a", F.col("b").alias("node"), *(undecided(x.eps).alias(m) for x, m in zip(questions, marks))).filter(any_open)
    todo = seekers.select(F.col("cell").alias("a"), "v", *names).join(started, "a").drop("a")
    on_path = placed(others, trees)
    value = sorted({x.value for x in questions})
    at_leaf = _leaves(on_path).select("node", *[F.col(c).alias(f"y_{c}") for c in names], *value)
    found = []

    def compared(rows: DataFrame) -> DataFrame:
        apart = _total([(F.col(c) - F.col(f"y_{c}")) * (F.col(c) - F.col(f"y_{c}")) for c in names])
        return rows.join(at_leaf, "node").groupBy("v").agg(*[
            x.over(F.when(F.col(m) & (apart <= x.eps * x.eps), F.col(x.value))).alias(a) for x, m, a in zip(questions, marks, answers)
        ])

    if known is not None:
        todo = cut_lineage(_unanswered(todo, [known], questions, marks, answers))
    if trees.paths is None:
        return compared(todo)
    nodes = _children(on_path, names, [x.over(F.col(x.value)).alias(f"held_{q}") for q, x in enumerate(questions)], False)
    for level in range(trees.levels + 1):
        split = nodes.select(F.col("parent").alias("node")).distinct()
        at_leaves = todo.join(split, "node", "left_anti")
        found.append(cut_lineage(compared(at_leaves)))
        met = todo.join(nodes.withColumnRenamed("node", "child").withColumnRenamed("parent", "node"), "node")
        gaps = [F.greatest(F.col(f"lo{i}") - F.col(c), F.col(c) - F.col(f"hi{i}"), F.lit(0.0)) for i, c in enumerate(names)]
        spans = [F.greatest(F.col(f"hi{i}") - F.col(c), F.col(c) - F.col(f"lo{i}")) for i, c in enumerate(names)]
        met = cut_lineage(met.withColumns({"near": _total([g * g for g in gaps]), "far": _total([s * s for s in spans])}).select(
            "v", *names, F.col("child").alias("node"),
            *[F.when(F.col(m) & whole(x.eps), F.col(f"held_{q}")).alias(a) for q, (x, m, a) in enumerate(zip(questions, marks, answers))],
            *[(F.col(m) & undecided(x.eps)).alias(m) for x, m in zip(questions, marks)],
        ))
        found.append(met.groupBy("v").agg(*[x.over(F.col(a)).alias(a) for x, a in zip(questions, answers)]))
        todo = met.filter(any_open).drop(*answers)
        if any(x.enough is not None for x in questions):
            todo = _unanswered(todo, [*found, *([known] if known is not None else [])], questions, marks, answers)
        todo = cut_lineage(todo)
        if todo.isEmpty():
            break
    return _combined(found, questions, answers)


def _combined(found: list[DataFrame], questions: list[Question], answers: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, found).groupBy("v").agg(*[x.over(F.col(a)).alias(a) for x, a in zip(questions, answers)])


def _unanswered(todo: DataFrame, found: list[DataFrame], questions: list[Question], marks: list[str], answers: list[str]) -> DataFrame:
    """``todo`` without the questions whose answers have reached what is enough."""
    so_far = _combined(found, questions, answers)
    enough = [F.coalesce(F.col(a) >= x.enough, F.lit(False)) if x.enough is not None else F.lit(False) for x, a in zip(questions, answers)]
    final = so_far.select("v", *[e.alias(f"final_{q}") for q, e in enumerate(enough)])
    closed = {m: F.col(m) & ~F.coalesce(f"final_{q}", F.lit(False)) for q, m in enumerate(marks)}
    left = todo.join(final, "v", "left").withColumns(closed).drop(*(f"final_{q}" for q in range(len(marks))))
    return left.filter(reduce(lambda a, b: a | b, [F.col(m) for m in marks]))


def touching(pairs: DataFrame, vectors: DataFrame, trees: Trees, names: list[str], eps: float) -> DataFrame:
    """(a, b): those undecided ``pairs`` of cells that hold two of the ``vectors`` within ``eps`` of each other."""
    todo = pairs.filter(undecided(eps)).select("a", "b", F.col("a").alias("na"), F.col("b").alias("nb"))
    on_path = placed(vectors, trees)
    at_leaf = _leaves(on_path).select("node", *names)
    left = at_leaf.withColumnRenamed("node", "na")
    right = at_leaf.select(F.col("node").alias("nb"), *[F.col(c).alias(f"y_{c}") for c in names])
    apart = _total([(F.col(c) - F.col(f"y_{c}")) * (F.col(c) - F.col(f"y_{c}")) for c in names])

    def compared(rows: DataFrame) -> DataFrame:
        return rows.join(left, "na").join(right, "nb").filter(apart <= eps * eps).select("a", "b").distinct()

    if trees.paths is None:
        return compared(todo)
    nodes = _children(on_path, names, [], True)
    mine = nodes.select(F.col("parent").alias("na"), F.col("node").alias("ca"), F.col("ends").alias("ea"), *[F.col(f"{s}{i}").alias(f"a{s}{i}") for i in range(len(names)) for s in ("lo", "hi")])
    theirs = nodes.select(F.col("parent").alias("nb"), F.col("node").alias("cb"), F.col("ends").alias("eb"), *[F.col(f"{s}{i}").alias(f"b{s}{i}") for i in range(len(names)) for s in ("lo", "hi")])
    gaps = [F.greatest(F.col(f"blo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"bhi{i}"), F.lit(0.0)) for i in range(len(names))]
    spans = [F.greatest(F.col(f"bhi{i}") - F.col(f"alo{i}"), F.col(f"ahi{i}") - F.col(f"blo{i}")) for i in range(len(names))]
    linked, to_compare = [], []
    for _ in range(trees.levels + 1):
        met = cut_lineage(todo.join(mine, "na").join(theirs, "nb").select(
            "a", "b", F.col("ca").alias("na"), F.col("cb").alias("nb"), (F.col("ea") & F.col("eb")).alias("ends"),
            _total([g * g for g in gaps]).alias("near"), _total([s * s for s in spans]).alias("far"),
        ).filter(F.col("near") <= eps * eps * (1 + SLACK)))
        linked.append(cut_lineage(met.filter(whole(eps)).select("a", "b").distinct()))
        still = met.join(linked[-1], ["a", "b"], "left_anti").select("a", "b", "na", "nb", "ends")
        to_compare.append(still.filter("ends").drop("ends"))
        todo = cut_lineage(still.filter("NOT ends").drop("ends"))
        if todo.isEmpty():
            break
    sure = reduce(DataFrame.unionByName, linked).distinct()
    rest = reduce(DataFrame.unionByName, to_compare).join(sure, ["a", "b"], "left_anti")
    return sure.unionByName(compared(rest)).distinct()
