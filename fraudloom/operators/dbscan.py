"""Density clustering (DBSCAN) of numeric rows.

Equal rows collapse into weighted vectors, and vectors into cells so small that
all rows of a cell are neighbours. Cells know the exact bounds of their vectors,
so most pairs of cells are decided whole: too far apart, or everything within
the radius, counted by weight. Only the vectors of the remaining pairs are
asked for, through k-d trees of the cells that hold many (``refine``): a question ends
where bounds decide, where one neighbour is enough, or at ``min_samples``.

Neighbouring cells are found a few dimensions at a time. A level extends each
pair of neighbouring prefixes by the next dimensions' cells and drops a pair as
soon as its distance so far exceeds the radius; joins are on the prefix and on a
coarse bucket of the next dimension, so only occupied neighbours ever meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.components import connected_components
from fraudloom.operators.numbering import number_rows
from fraudloom.operators.refine import LEAF, SLACK, Question, Trees, ask, grow, touching
from fraudloom.operators.refine import undecided as _open
from fraudloom.operators.refine import whole as _whole
from fraudloom.plans.sizing import sized
from fraudloom.schemas import KEY_COLS
from fraudloom.session import cut_lineage

LEVEL_CELLS = 300

# The searched settings, in the order they are tried.
EPS_VALUES = [0.3, 0.5, 0.7]
MIN_SAMPLES_VALUES = [3, 5, 7]
DEFAULT = (0.5, 5)
TARGET_OUTLIERS = 20


@dataclass(frozen=True)
class Vectors:
    """Distinct rows ``x0..`` with weight ``w``, number ``v`` and cell name."""

    table: DataFrame
    width: int
    side: float

    @property
    def names(self) -> list[str]:
        return [f"x{i}" for i in range(self.width)]


@dataclass(frozen=True)
class Settings:
    """The (eps, min_samples) pairs tried together."""

    pairs: list[tuple[float, int]]

    @property
    def radii(self) -> list[float]:
        return sorted({e for e, _ in self.pairs})

    @property
    def most(self) -> int:
        return max(m for _, m in self.pairs)


def _vectors(features: list[str]) -> list[Column]:
    """The features as doubles, -0.0 as 0.0."""
    return [(F.col(c).cast("double") + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]


def _cell_index(c: Column, side: float) -> Column:
    return F.floor(c / F.lit(side))


def weigh(df: DataFrame, features: list[str], side: float, key_cols: list[str] | None = None) -> Vectors:
    """Distinct vectors with weights and, given ``key_cols``, their least row key."""
    rows = df.dropna(subset=features).select(*(key_cols or []), *_vectors(features))
    names = [f"x{i}" for i in range(len(features))]
    aggs = [F.count(F.lit(1)).alias("w")]
    if key_cols:
        aggs.append(F.min(F.struct(*key_cols)).alias("first_key"))
    table = rows.groupBy(*names).agg(*aggs).withColumns(
        {
            "v": F.monotonically_increasing_id(),
            "cell": F.concat_ws(",", *[_cell_index(F.col(c), side).cast("string") for c in names]),
        }
    )
    return Vectors(cut_lineage(table), len(features), side)


def _levels(vectors: Vectors) -> list[list[int]]:
    """Dimensions in the order of their distinct cells, grouped while few combine.

    Planned on approximate distinct counts over all vectors; only the speed
    depends on it.
    """
    index = [_cell_index(F.col(c), vectors.side) for c in vectors.names]
    table, width = vectors.table, vectors.width
    alone = table.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(index)]).first()
    order = sorted(range(width), key=lambda d: (alone[f"n{d}"], d))
    runs = [(i, j) for i in range(width) for j in range(i + 1, width + 1)]
    joint = table.agg(
        *[F.approx_count_distinct(F.xxhash64(*[index[d] for d in order[i:j]])).alias(f"n{i}_{j}") for i, j in runs]
    ).first()
    levels, first = [[order[0]]], 0
    for at in range(1, width):
        if joint[f"n{first}_{at + 1}"] <= LEVEL_CELLS:
            levels[-1].append(order[at])
        else:
            levels.append([order[at]])
            first = at
    return levels


def _cells(vectors: Vectors, sure_from: int) -> DataFrame:
    """Cells with weight ``W``, bounds ``lo*``/``hi*`` and whether they hold
    ``sure_from`` rows, which makes all of them core."""
    bounds = [f(c).alias(f"{n}{i}") for i, c in enumerate(vectors.names) for n, f in (("lo", F.min), ("hi", F.max))]
    cells = vectors.table.groupBy("cell").agg(F.sum("w").alias("W"), *bounds)
    return cut_lineage(cells.withColumn("sure", F.col("W") >= sure_from))


def _nodes(cells: DataFrame, vectors: Vectors, levels: list[list[int]], reach: int) -> DataFrame:
    """Every occupied prefix of every level: parent, bounds over the level's own
    dimensions, a bucket of its first one, and the same bounds over the cells
    that seek neighbours."""
    index = [_cell_index(F.col(f"lo{d}"), vectors.side) for d in range(vectors.width)]
    records, done = [], []
    for k, dims in enumerate(levels):
        parent = F.concat_ws(",", *[index[d].cast("string") for d in done]) if done else F.lit("")
        done = done + dims
        records.append(
            F.struct(
                F.lit(k).alias("level"),
                parent.alias("parent"),
                F.concat_ws(",", *[index[d].cast("string") for d in done]).alias("node"),
                F.floor(index[dims[0]] / F.lit(reach)).alias("bucket"),
                F.array(*[F.col(f"lo{d}") for d in dims]).alias("lo"),
                F.array(*[F.col(f"hi{d}") for d in dims]).alias("hi"),
            )
        )
    long = cells.select("seeks", F.explode(F.array(*records)).alias("r")).select("seeks", "r.*")
    widest = max(len(dims) for dims in levels)
    aggs = []
    for i in range(widest):
        lo, hi = F.get("lo", F.lit(i)), F.get("hi", F.lit(i))
        aggs += [
            F.min(lo).alias(f"blo{i}"), F.max(hi).alias(f"bhi{i}"),
            F.min(F.when(F.col("seeks"), lo)).alias(f"alo{i}"), F.max(F.when(F.col("seeks"), hi)).alias(f"ahi{i}"),
        ]
    return cut_lineage(long.groupBy("level", "parent", "node", "bucket").agg(F.max("seeks").alias("seeks"), *aggs))


def _cell_pairs(cells: DataFrame, vectors: Vectors, levels: list[list[int]], eps: float) -> DataFrame:
    """(a, b, near, far): cells and the squared bounds on their distance, for every
    seeking cell ``a`` and every cell ``b`` that may lie within ``eps``.

    Only nodes are repeated for the neighbouring buckets, never pairs.
    """
    reach = math.ceil(eps / vectors.side) + 2
    nodes = _nodes(cells, vectors, levels, reach)
    limit = eps * eps * (1 + SLACK)
    pairs = cells.sparkSession.createDataFrame([("", "", 0.0, 0.0)], "a string, b string, near double, far double")
    for k, dims in enumerate(levels):
        mine = nodes.filter((F.col("level") == k) & F.col("seeks")).select(
            F.col("parent").alias("a"), F.col("node").alias("a_node"), "bucket",
            *[F.col(f"a{s}{i}") for i in range(len(dims)) for s in ("lo", "hi")],
        )
        theirs = nodes.filter(F.col("level") == k).select(
            F.col("parent").alias("b"), F.col("node").alias("b_node"),
            F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])).alias("bucket"),
            *[F.col(f"b{s}{i}") for i in range(len(dims)) for s in ("lo", "hi")],
        )
        gaps = [
            F.greatest(F.col(f"blo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"bhi{i}"), F.lit(0.0))
            for i in range(len(dims))
        ]
        spans = [
            F.greatest(F.col(f"bhi{i}") - F.col(f"alo{i}"), F.col(f"ahi{i}") - F.col(f"blo{i}"))
            for i in range(len(dims))
        ]
        # a level multiplies the pairs, so they are dealt out again before it
        pairs = pairs.repartition("a").join(mine, "a").join(theirs, ["b", "bucket"]).select(
            F.col("a_node").alias("a"), F.col("b_node").alias("b"),
            (F.col("near") + reduce(add, [g * g for g in gaps])).alias("near"),
            (F.col("far") + reduce(add, [s * s for s in spans])).alias("far"),
        ).filter(F.col("near") <= limit)
    return _named(pairs, vectors, levels)


def _named(pairs: DataFrame, vectors: Vectors, levels: list[list[int]]) -> DataFrame:
    """Node names list the dimensions level by level; cell names list them in order."""
    place = {d: i for i, d in enumerate(d for dims in levels for d in dims)}

    def renamed(c: str) -> Column:
        parts = F.split(F.col(c), ",")
        return F.concat_ws(",", *[F.get(parts, F.lit(place[d])) for d in range(vectors.width)]).alias(c)

    return pairs.select(renamed("a"), renamed("b"), "near", "far")


@dataclass(frozen=True)
class DbscanRun:
    """Vectors with 0/1 ``core_{s}`` and ``noise_{s}`` per setting, the largest radius' cell pairs and the dense cells' trees."""

    vectors: Vectors
    flags: DataFrame
    pairs: DataFrame
    settings: Settings
    trees: Trees

    def outliers(self) -> list[int]:
        sums = [
            F.coalesce(F.sum(F.col(f"noise_{s}") * F.col("w")), F.lit(0)).alias(f"n{s}")
            for s in range(len(self.settings.pairs))
        ]
        return [int(n) for n in self.flags.agg(*sums).first()]


def _rows_near(
    seekers: DataFrame, pairs: DataFrame, cells: DataFrame, vectors: Vectors, trees: Trees, eps: float, enough: int
) -> DataFrame:
    """``seekers`` (cell, v and coordinates) with ``n``, the rows within ``eps``; counting ends at ``enough``."""
    names = vectors.names
    whole = cut_lineage(pairs.filter(_whole(eps)).join(cells.select(F.col("cell").alias("b"), "W"), "b").groupBy(
        F.col("a").alias("cell")
    ).agg(F.sum("W").alias("whole")))
    done = whole.filter(F.col("whole") >= enough).select(F.col("cell").alias("a"))
    unclear = pairs.filter(_open(eps)).join(done, "a", "left_anti")
    known = seekers.join(whole, "cell").select("v", F.col("whole").alias("answer_0"))
    single = ask(
        seekers, unclear, vectors.table.select("cell", "v", "w", *names), trees, names,
        [Question(eps, "w", "sum", enough)], known if trees.levels else None,
    )
    counted = seekers.join(whole, "cell", "left").join(single, "v", "left")
    n = F.coalesce("whole", F.lit(0)) + F.coalesce("answer_0", F.lit(0))
    return counted.select("cell", "v", *names, n.alias("n"))


def _noise(
    counted: DataFrame, tests: dict[int, int], pairs: DataFrame, vectors: Vectors, trees: Trees, eps: float
) -> DataFrame:
    """(v, core_*, noise_*) of those ``counted`` within ``eps``, for the settings ``tests`` and their ``min_samples``.

    All other vectors are core.
    """
    names, cores = vectors.names, [f"core_{s}" for s in tests]
    own = cut_lineage(counted.select("cell", "v", *names, *[(F.col("n") >= m).cast("int").alias(f"core_{s}") for s, m in tests.items()]))
    loose = own.filter(F.least(*cores, F.lit(1)) == 0)
    asked = cut_lineage(pairs.join(loose.select(F.col("cell").alias("a")).distinct(), "a", "left_semi"))
    every = vectors.table.select("cell", "v", *names).join(own.select("v", *cores), "v", "left")
    anchors = cut_lineage(every.withColumns({c: F.coalesce(c, F.lit(1)) for c in cores}).filter(F.greatest(*cores, F.lit(0)) == 1))
    anchored = anchors.groupBy(F.col("cell").alias("b")).agg(*[F.max(c).alias(c) for c in cores])
    near_core = asked.filter(_whole(eps)).join(anchored, "b").groupBy(F.col("a").alias("cell")).agg(
        *[F.max(f"core_{s}").alias(f"whole_{s}") for s in tests]
    )
    reached = ask(
        loose, asked.filter(_open(eps)), anchors, trees, names, [Question(eps, c, "max", 1) for c in cores]
    ).withColumnsRenamed({f"answer_{i}": f"single_{s}" for i, s in enumerate(tests)})
    joined = own.join(near_core, "cell", "left").join(reached, "v", "left")
    noise = [
        F.when(F.greatest(f"core_{s}", f"whole_{s}", f"single_{s}") == 0, 1).otherwise(0).alias(f"noise_{s}") for s in tests
    ]
    return joined.select("v", *cores, *noise)


def find_noise(
    df: DataFrame, features: list[str], settings: list[tuple[float, int]],
    key_cols: list[str] | None = None, pair_all: bool = False, leaf: int = LEAF,
) -> DbscanRun:
    """Core and noise flags for every (eps, min_samples).

    A row is core with at least ``min_samples`` rows, itself included, within
    eps, and noise when it neither is core nor has a core row within eps. Radii
    are tried from the least on: a vector with as many rows within one as any
    setting asks for is core there and within all larger ones, and seeks no more,
    so that few rows lie around those that still seek. Cells whose own weight
    makes them core never seek, unless ``pair_all``, by which all cells do.
    """
    tried = Settings(settings)
    side = tried.radii[0] / math.sqrt(len(features)) * (1 - 1e-6)
    vectors = weigh(df, features, side, key_cols)
    names = vectors.names
    cells = _cells(vectors, tried.most)
    levels = _levels(vectors)
    trees = grow(vectors.table, names, leaf)
    seekers = cut_lineage(vectors.table.select("cell", "v", *names).join(cells.filter(~F.col("sure")).select("cell"), "cell"))
    flags = vectors.table
    for eps in tried.radii:
        own = seekers.select("cell").distinct().withColumn("open", F.lit(True))
        seeking = cells.join(own, "cell", "left").withColumn("seeks", F.lit(pair_all) | F.col("open").isNotNull())
        pairs = cut_lineage(_cell_pairs(seeking, vectors, levels, eps))
        counted = cut_lineage(_rows_near(seekers, pairs, cells, vectors, trees, eps, tried.most))
        tests = {s: m for s, (e, m) in enumerate(settings) if e == eps}
        flags = flags.join(cut_lineage(_noise(counted, tests, pairs, vectors, trees, eps)), "v", "left")
        seekers = cut_lineage(counted.filter(F.col("n") < tried.most).drop("n"))
    decided = {c: F.coalesce(c, F.lit(k)) for s in range(len(settings)) for c, k in ((f"core_{s}", 1), (f"noise_{s}", 0))}
    return DbscanRun(vectors, cut_lineage(flags.withColumns(decided)), pairs, tried, trees)


def _to_rows(
    df: DataFrame, features: list[str], key_cols: list[str], marks: DataFrame, n: int, out: str, other: int
) -> DataFrame:
    """Carry a column of some vectors to their rows; other rows get ``other``, incomplete rows null."""
    names = [f"x{i}" for i in range(len(features))]
    rows = df.select(*key_cols, *_vectors(features))
    joined = rows.join(sized(marks, n, 8 * (len(names) + 1)), names, "left")
    complete = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in names])
    return joined.select(*key_cols, F.when(complete, F.coalesce(F.col(out), F.lit(other))).cast("int").alias(out))


def noise_rows(
    df: DataFrame, features: list[str], run: DbscanRun, setting: int = 0,
    key_cols: list[str] | None = None, out: str = "DBSCAN",
) -> DataFrame:
    """Row key and 0/1 noise flag of every row, null where a feature is missing.

    Noise vectors have few copies, so none is hot.
    """
    found = run.flags.filter(F.col(f"noise_{setting}") == 1)
    marks = found.select(*run.vectors.names, F.lit(1).alias(out))
    return _to_rows(df, features, key_cols or KEY_COLS, marks, found.count(), out, 0)


def dbscan_noise(
    df: DataFrame, features: list[str], eps: float = DEFAULT[0], min_samples: int = DEFAULT[1],
    key_cols: list[str] | None = None, out: str = "DBSCAN", leaf: int = LEAF,
) -> DataFrame:
    return noise_rows(df, features, find_noise(df, features, [(eps, min_samples)], leaf=leaf), 0, key_cols, out)


@dataclass(frozen=True)
class DbscanSearch:
    runs: DataFrame
    best: tuple[float, int]
    run: DbscanRun
    setting: int


def dbscan_search(
    df: DataFrame,
    features: list[str],
    eps_values: list[float] = EPS_VALUES,
    min_samples_values: list[int] = MIN_SAMPLES_VALUES,
    target_outliers: int = TARGET_OUTLIERS,
) -> DbscanSearch:
    """Outlier counts of every setting; the best comes closest to the target,
    the first on ties."""
    settings = [(e, m) for e in eps_values for m in min_samples_values] or [DEFAULT]
    run = find_noise(df, features, settings)
    found = run.outliers()
    best = min(range(len(settings)), key=lambda i: abs(found[i] - target_outliers))
    runs = df.sparkSession.createDataFrame(
        [(e, m, n) for (e, m), n in zip(settings, found)], "eps double, min_samples int, n_outliers long"
    )
    return DbscanSearch(runs, settings[best], run, best)


def dbscan_clusters(
    df: DataFrame, features: list[str], eps: float = DEFAULT[0], min_samples: int = DEFAULT[1],
    key_cols: list[str] | None = None, out: str = "cluster", leaf: int = LEAF,
) -> DataFrame:
    """Row key and cluster number, -1 for noise, null where a feature is missing.

    Clusters are numbered from 0 by their least core row key, and a border row
    joins its lowest-numbered neighbour, as a scan in key order would find them.
    The core rows of a cell are neighbours, so the component search runs on
    cells.
    """
    key_cols = key_cols or KEY_COLS
    run = find_noise(df, features, [(eps, min_samples)], key_cols, pair_all=True, leaf=leaf)
    names = run.vectors.names
    core = run.flags.filter(F.col("core_0") == 1)
    nodes = cut_lineage(core.groupBy("cell").agg(F.min("v").alias("node"), F.min("first_key").alias("first_key")))
    named = run.pairs.join(nodes.select(F.col("cell").alias("a"), F.col("node").alias("na")), "a").join(
        nodes.select(F.col("cell").alias("b"), F.col("node").alias("nb")), "b"
    ).filter("na < nb")
    whole = named.filter(_whole(eps)).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    met = touching(named, core.select("cell", "v", *names), run.trees, names, eps)
    single = named.join(met, ["a", "b"]).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    parts = connected_components(nodes.select("node"), whole.unionByName(single).distinct())
    members = cut_lineage(nodes.join(parts, "node"))
    firsts = members.groupBy("component").agg(F.min("first_key").alias("first_key"))
    numbered = number_rows(firsts, ["first_key"], out).select("component", out)
    labels = cut_lineage(members.join(numbered, "component").select("cell", out))

    loose = run.flags.filter((F.col("core_0") == 0) & (F.col("noise_0") == 0))
    touched = run.pairs.join(labels.withColumnRenamed("cell", "b"), "b")
    by_cell = touched.filter(_whole(eps)).groupBy(F.col("a").alias("cell")).agg(F.min(out).alias("_whole"))
    labelled = core.join(labels, "cell").select("cell", "v", *names, out)
    by_vector = ask(
        loose, touched.filter(_open(eps)).select("a", "b", "near", "far"), labelled, run.trees, names, [Question(eps, out, "min")]
    ).withColumnRenamed("answer_0", "_single")
    border = loose.join(by_cell, "cell", "left").join(by_vector, "v", "left")
    border = border.select(*names, F.least("_whole", "_single").alias(out))
    marks = cut_lineage(core.join(labels, "cell").select(*names, out).unionByName(border))
    return _to_rows(df, features, key_cols, marks, marks.count(), out, -1)
