"""Exact percentiles whose memory and shuffles do not grow with the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.operators.numbering import POSITION_BITS
from fraudloom.session import cut_lineage

#: Distinct values up to which one task may take a percentile from their counts.
EXACT_ROWS = 1_000_000
#: Size of a sketch, and the share of ranks on either side of a wanted one within which it is sought.
SKETCH = 1024
MARGIN = 0.01


def exact_percentile(df: DataFrame, column: str, p: float, exact_rows: int = EXACT_ROWS) -> float | None:
    return exact_percentiles(df, [column], [p], exact_rows)[column][0]


def exact_percentiles(
    df: DataFrame, columns: list[str], ps: list[float], exact_rows: int = EXACT_ROWS
) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles (0 to 1) of each column's non-null values.

    One scan makes a mergeable sketch per column, whose quantiles on either side of a
    wanted rank bracket it. The next one counts what lies below the bracket, one number
    per task, and counts values only inside, where the rank is then found. While
    brackets may hold more than ``exact_rows`` rows, sketches of what is inside narrow
    them first. A bracket that turns out to miss its rank, as sketches may err, is
    replaced by a range sort of all values.
    """
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    first = values.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(values.columns) for n, f in (("n", F.count), ("s", _sketch))]).first()
    wanted = {}
    for i in range(len(columns)):
        for j, p in enumerate(ps):
            if first[f"n{i}"]:
                wanted[i, j] = _Rank(float(p) * (first[f"n{i}"] - 1), 0, first[f"n{i}"], bytes(first[f"s{i}"]) if first[f"s{i}"] else None)
    found: dict[tuple[int, int], float | None] = {}
    if wanted:
        _bracket(df, wanted)
        while any(r.size > 1 and r.size * 4 * MARGIN > exact_rows for r in wanted.values()):
            _narrow(values, wanted)
            _bracket(df, wanted)
        found = _picked(values, wanted)
    out = {c: [found.get((i, j)) for j in range(len(ps))] for i, c in enumerate(columns)}
    for i, c in enumerate(columns):
        if any((i, j) in wanted and out[c][j] is None for j in range(len(ps))):
            names = {f"q{j}": float(p) for j, p in enumerate(ps)}
            counts = values.filter(F.col(f"v{i}").isNotNull()).groupBy(F.col(f"v{i}").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
            row = _ranked(counts.select(F.lit(0).alias("_g"), "_v", "_n"), "g", names).first()
            out[c] = [row[q] for q in names]
    return out


class _Rank:
    """A wanted rank among the values of a bracket: ``size`` values in it (of which a sketch tells), ``below`` smaller ones."""

    def __init__(self, rank: float, below: int, size: int, sketch: bytes | None):
        self.rank, self.below, self.size, self.sketch = rank, below, size, sketch
        self.lo: float | None = None  # None: no bound on this side
        self.hi: float | None = None

    def inside(self, c: Column) -> Column:
        terms = [c.isNotNull()] + ([c >= self.lo] if self.lo is not None else []) + ([c <= self.hi] if self.hi is not None else [])
        return reduce(lambda a, b: a & b, terms)

    def under(self, c: Column) -> Column:
        return c < self.lo if self.lo is not None else F.lit(False)


def _sketch(c) -> Column:
    return F.kll_sketch_agg_double(c, F.lit(SKETCH))


def _bracket(df: DataFrame, wanted: dict) -> None:
    """Set each rank's bounds from its sketch: the quantiles ``MARGIN`` below and above it."""
    known = {
        (i, j): (r.sketch, (r.rank - r.below) / r.size - MARGIN, (r.rank - r.below + 1) / r.size + MARGIN)
        for (i, j), r in wanted.items() if r.sketch and r.size > 1
    }
    # a bracket that reaches an end of its range keeps the bound that the range had
    told = [
        F.kll_sketch_get_quantile_double(F.lit(bytearray(sketch)), F.lit(at)).alias(f"{side}{i}_{j}")
        for (i, j), (sketch, a, b) in known.items() for side, at in (("lo", a), ("hi", b)) if 0 < at < 1
    ]
    row = df.sparkSession.range(1).select(F.lit(0).alias("none"), *told).first().asDict()
    for i, j in known:
        r = wanted[i, j]
        r.lo, r.hi = row.get(f"lo{i}_{j}", r.lo), row.get(f"hi{i}_{j}", r.hi)


def _narrow(values: DataFrame, wanted: dict) -> None:
    """Count below and inside each bracket, and sketch what is inside."""
    aggs, open_ = [], {at: r for at, r in wanted.items() if r.size > 1}
    for (i, j), r in open_.items():
        c = F.col(f"v{i}")
        aggs += [
            F.count(F.when(r.under(c), 1)).alias(f"below{i}_{j}"), F.count(F.when(r.inside(c), 1)).alias(f"size{i}_{j}"),
            _sketch(F.when(r.inside(c), c)).alias(f"s{i}_{j}"),
        ]
    row = values.agg(*aggs).first()
    for (i, j), r in open_.items():
        before = r.size
        r.below, r.size, sketch = row[f"below{i}_{j}"], row[f"size{i}_{j}"], row[f"s{i}_{j}"]
        r.sketch = bytes(sketch) if sketch else None
        if r.size == before or r.lo == r.hi:  # one value fills it: counting by value is cheap however many rows
            r.size = 1


def _picked(values: DataFrame, wanted: dict) -> dict[tuple[int, int], float | None]:
    """The percentile of each bracket from counts by value inside and one count of all below; None where the rank lies outside."""
    records = []
    for (i, j), r in wanted.items():
        c = F.col(f"v{i}")
        records.append(F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), (r.under(c) | r.inside(c)).alias("counts"),
            F.when(r.inside(c), c).alias("v"), F.lit(r.rank).alias("rank"),
        ))
    long = values.select(F.explode(F.array(*records)).alias("r")).select("r.*").filter(F.col("counts"))
    counts = long.groupBy("i", "j", "rank", "v").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("i", "j").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("n").over(so_far))
    sides = []
    for side, at in (("lo", F.floor("rank")), ("hi", F.ceil("rank"))):
        sides.append(F.max(F.when((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at), F.col("v"))).alias(side))
    rows = placed.groupBy("i", "j", "rank").agg(*sides).collect()
    return {
        (r["i"], r["j"]): None if r["lo"] is None or r["hi"] is None else r["lo"] if r["lo"] == r["hi"] else r["lo"] + (r["rank"] - int(r["rank"])) * (r["hi"] - r["lo"])
        for r in rows
    }


def grouped_percentiles(df: DataFrame, group: str, value: str, ps: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles per group: (group, *names of ps).

    Equal values are counted before the shuffle, and the sort spreads one large
    group over many range partitions. A row's rank is its place inside its
    partition plus the counts of the group's earlier partitions, so no task ever
    holds a whole group.
    """
    values = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    counts = values.filter(F.col("_v").isNotNull()).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return _ranked(counts, group, ps)


def _ranked(counts: DataFrame, group: str, ps: dict[str, float]) -> DataFrame:
    """Percentiles per group from (_g, _v, _n): distinct values and how often each occurs."""
    stored = cut_lineage(counts.orderBy("_g", "_v").withColumn("_at", F.monotonically_increasing_id()))
    stored = stored.withColumn("_part", F.shiftright("_at", POSITION_BITS))
    # one row per group and partition it touches
    spans = stored.groupBy("_g", "_part").agg(F.sum("_n").alias("_size"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    spans = spans.select(
        "_g", "_part",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored.join(spans, ["_g", "_part"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    aggs = []
    for i, p in enumerate(ps.values()):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            covers = (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
            aggs.append(F.max(F.when(covers, F.col("_v"))).alias(f"{side}{i}"))
    picked = placed.groupBy("_g").agg(F.first("_total").alias("_total"), *aggs)
    columns = [F.col("_g").alias(group)]
    for i, (name, p) in enumerate(ps.items()):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        columns.append((lo + (rank - F.floor(rank)) * (hi - lo)).alias(name))
    return picked.select(*columns)
