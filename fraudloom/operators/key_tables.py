"""Per-key counts, distinct counts and sorted codes, for all keys in one scan.

Each input row yields one narrow record per key, and one more per distinct
count. A first grouping by (key, value, slot, member) removes copies before the
shuffle and spreads a hot value over its members; a second one folds the members
into one row per value. Sorting those rows numbers them: every range partition
numbers its own, and only row counts per partition visit the driver, so a key
may hold billions of values.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.numbering import POSITION_BITS
from fraudloom.plans.sizing import SALT_FROM_ROWS, KeyProfile, hot_share, join_back, sized
from fraudloom.session import cut_lineage

@dataclass(frozen=True)
class Measure:
    """``fn`` is ``count``, ``distinct`` or ``many`` (distinct > 1) of ``value`` by ``key``."""

    out: str
    key: str
    fn: str
    value: str


@dataclass(frozen=True)
class KeyTable:
    key: str
    table: DataFrame
    profile: KeyProfile
    code: str | None = None

    def join_to(self, df: DataFrame, salt_by: list[str]) -> DataFrame:
        return join_back(df, self.table, self.key, self.profile, salt_by)


def code_column(key: str) -> str:
    return f"_code_{key}"


def fit_key_tables(
    df: DataFrame,
    measures: list[Measure],
    coded: list[str] = (),
    labels: dict[str, str] | None = None,
    approx: bool = False,
    salt_from_rows: int = SALT_FROM_ROWS,
) -> dict[str, KeyTable]:
    """One table per key: its measures and, for ``coded`` keys, its sorted code.

    ``labels`` give missing values of a coded key a text of their own; measures
    still skip the rows whose key was missing.
    """
    labels = labels or {}
    groups: dict[str, list[Measure]] = {c: [] for c in coded}
    for m in measures:
        groups.setdefault(m.key, []).append(m)
    counts, members = _by_kind(groups)
    folded = _fold(df, counts, members, labels, approx)
    if coded:
        folded = folded.orderBy("_key", "_value")
    stored = cut_lineage(folded.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", POSITION_BITS)
    spans = (
        stored.groupBy(part.alias("_part"), "_key")
        .agg(
            F.count("_value").alias("n"),
            F.sum("_rows").alias("rows"),
            F.min(F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("first"),
            F.max(F.octet_length("_value")).alias("bytes"),
        )
        .collect()
    )
    profiles = _profiles(stored, spans, groups, salt_from_rows)
    numbered = stored
    if coded:
        numbered = stored.withColumn("_part", part).join(_shifts(df, spans), ["_part", "_key"])
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for key in groups:
        columns = [F.col("_value").cast(types[key]).alias(key)]
        columns += [F.col(f"_c{i}").alias(m.out) for i, m in enumerate(counts[key])]
        for i, m in enumerate(members[key]):
            n = F.col(f"_d{i}")
            columns.append((n > 1 if m.fn == "many" else n).alias(m.out))
        if key in coded:
            columns.append((F.col("_at") + F.col("_shift")).alias(code_column(key)))
        rows = (numbered if key in coded else stored).filter((F.col("_key") == key) & F.col("_value").isNotNull())
        out[key] = KeyTable(key, rows.select(*columns), profiles[key], code_column(key) if key in coded else None)
    return out


def _by_kind(groups: dict[str, list[Measure]]) -> tuple[dict, dict]:
    counts = {k: [m for m in ms if m.fn == "count"] for k, ms in groups.items()}
    members = {k: [m for m in ms if m.fn != "count"] for k, ms in groups.items()}
    return counts, members


def rows_where(df: DataFrame, rules: dict[str, tuple[Measure, int]], approx: bool = False) -> DataFrame:
    """(rule, n_rows): rows whose group measure exceeds the rule's limit.

    The groups carry their row counts, so nothing is joined back to the rows.
    """
    groups: dict[str, list[Measure]] = {}
    for m, _ in rules.values():
        groups.setdefault(m.key, []).append(m)
    counts, members = _by_kind(groups)
    folded = _fold(df, counts, members, {}, approx).filter(F.col("_value").isNotNull())
    sums = []
    for m, limit in rules.values():
        kind, slot = ("_c", counts[m.key].index(m)) if m.fn == "count" else ("_d", members[m.key].index(m))
        hit = (F.col("_key") == m.key) & (F.col(f"{kind}{slot}") > limit)
        sums.append(F.coalesce(F.sum(F.when(hit, F.col("_rows"))), F.lit(0)))
    one = folded.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"s{i}").alias("n_rows")) for i, name in enumerate(rules)]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def _fold(df, counts, members, labels, approx) -> DataFrame:
    n_counts = max(len(v) for v in counts.values())
    n_members = max(len(v) for v in members.values())
    records = []
    for key in counts:
        value = F.col(key).cast("string")
        present = F.lit(True)
        if key in labels:
            present = F.col(key).isNotNull()
            value = F.coalesce(value, F.lit(labels[key]))
        ones = [(present & F.col(m.value).isNotNull()).cast("long") for m in counts[key]]
        records.append(_record(key, value, 0, None, F.lit(1), ones, n_counts))
        for slot, m in enumerate(members[key]):
            member = F.when(present, F.col(m.value).cast("string"))
            records.append(_record(key, value, slot + 1, member, F.lit(0), [], n_counts))
    long = df.select(F.explode(F.array(*records)).alias("r")).select("r.*")
    # members without a key, or missing ones, count nowhere: they need not be shuffled
    long = long.filter("_slot = 0 OR (_value IS NOT NULL AND _member IS NOT NULL)")
    numbers = ["_rows"] + [f"_c{i}" for i in range(n_counts)]
    if not approx and n_members:
        long = long.groupBy("_key", "_value", "_slot", "_member").agg(*[F.sum(c).alias(c) for c in numbers])
    sums = [F.sum(c).alias(c) for c in numbers]
    for i in range(n_members):
        member = F.when(F.col("_slot") == i + 1, F.col("_member"))
        # members are already distinct here, so counting them is enough
        sums.append((F.approx_count_distinct(member) if approx else F.count(member)).alias(f"_d{i}"))
    return long.groupBy("_key", "_value").agg(*sums)


def _record(key, value: Column, slot: int, member: Column | None, row: Column, ones, n_counts) -> Column:
    ones = ones + [F.lit(0).cast("long")] * (n_counts - len(ones))
    return F.struct(
        F.lit(key).alias("_key"),
        value.alias("_value"),
        F.lit(slot).alias("_slot"),
        (F.lit(None).cast("string") if member is None else member).alias("_member"),
        row.cast("long").alias("_rows"),
        *[c.alias(f"_c{i}") for i, c in enumerate(ones)],
    )


def _profiles(stored, spans, groups, salt_from_rows) -> dict[str, KeyProfile]:
    total = {k: sum(s["rows"] for s in spans if s["_key"] == k) for k in groups}
    share = hot_share(stored.sparkSession)
    floors = {k: n * share for k, n in total.items() if n >= salt_from_rows}
    hot = defaultdict(list)
    if floors:
        heavy = F.lit(False)
        for k, floor in floors.items():
            heavy = heavy | ((F.col("_key") == k) & (F.col("_rows") >= floor))
        for r in stored.filter(heavy).select("_key", "_value").collect():
            hot[r["_key"]].append(r["_value"])
    return {
        k: KeyProfile(
            distinct=sum(s["n"] for s in spans if s["_key"] == k),
            max_bytes=max([s["bytes"] or 0 for s in spans if s["_key"] == k], default=0),
            hot=tuple(v for v in hot[k] if v is not None),
            hot_null=None in hot[k],
        )
        for k in groups
    }


def _shifts(df: DataFrame, spans) -> DataFrame:
    seen, shifts = defaultdict(int), []
    for row in sorted((s for s in spans if s["n"]), key=lambda r: r["first"]):
        shifts.append((row["_part"], row["_key"], seen[row["_key"]] - row["first"]))
        seen[row["_key"]] += row["n"]
    shift = df.sparkSession.createDataFrame(shifts, "_part long, _key string, _shift long")
    return sized(shift, len(shifts), 64)
