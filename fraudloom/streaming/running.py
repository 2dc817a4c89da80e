"""Group features that follow the stream: each row sees its group as of its own arrival.

Keys are dealt into ``BUCKETS`` buckets by their hash, and a bucket is one group of
``transformWithState``: every call to the state costs far more than a row does, so many
keys share one. Rows come and leave in blocks, Arrow tables packed before the shuffle,
as a row handed over by itself costs far more than its counts do. The state of a bucket
is a log of what its keys gained (counts, and for distinct counts the members first
seen), read once and added to once per micro-batch, one text for all that a micro-batch
adds. A log that holds more than twice what its sums need is written anew. A key's set
goes on in state entries of its own beyond ``INLINE`` members, so that no log grows with
one key. A row's counts include the row itself. State is checkpointed with the stream,
so a restarted stream goes on where it stopped; history from before the stream can be
put in once, by ``history``.

Rows of one micro-batch are taken in the order of ``order``, and micro-batches in the
order of their arrival; a late row counts from its arrival on. Rows whose key is null
keep null measures and no state, and are dealt out over all buckets, so that
they do not meet in one task. The state of a key lies in one task, as running counts
need an order: use this for keys of many values (cards, customers, users) and static
tables for the few values of a state or a country.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from fraudloom.operators.group_features import FEATURES
from fraudloom.operators.key_tables import Measure

#: Groups that share the keys; a stream's state is laid out by it, so it must not change between restarts.
BUCKETS = 16_384
#: Members of a key's set that are kept in its bucket's log.
INLINE = 1024
#: Bytes of rows that are dealt into blocks at once, and rows of a block that leaves a bucket.
BLOCK_BYTES, BLOCK_ROWS = 1 << 26, 1 << 16
#: The state store that arbitrary keyed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _counted_fields(measures: list[Measure]) -> list[StructField]:
    return [StructField(m.out, BooleanType() if m.fn == "many" else LongType()) for m in measures]


#: What one micro-batch adds: [key, slot, n, member] as JSON.
_LOGGED = StructType([StructField("entries", StringType())])
_MEMBER = StructType([StructField("key", StringType()), StructField("slot", IntegerType()), StructField("member", StringType())])


def _text_of(entries: list[tuple]) -> tuple[str]:
    return (json.dumps(entries, ensure_ascii=False, separators=(",", ":")),)


class _Bucket:
    """What a log says: totals by slot and key, and the members it names."""

    def __init__(self, slots: int, log: Iterable[tuple[str]]):
        self.totals: list[dict[str, int]] = [defaultdict(int) for _ in range(slots)]
        self.members: list[dict[str, set[str]]] = [defaultdict(set) for _ in range(slots)]
        self.entries = 0
        for (text,) in log:
            for key, slot, n, member in json.loads(text):
                self.entries += 1
                self.totals[slot][key] += n
                if member is not None:
                    self.members[slot][key].add(member)

    def _rest(self) -> Iterator[tuple]:
        """What the named members leave of the totals."""
        for slot, (totals, members) in enumerate(zip(self.totals, self.members)):
            for key, n in totals.items():
                if n := n - len(members.get(key, ())):
                    yield key, slot, n, None

    def needed(self) -> int:
        """Entries of the shortest log that says the same."""
        return sum(len(seen) for members in self.members for seen in members.values()) + sum(1 for _ in self._rest())

    def compact(self) -> list[tuple]:
        """The shortest log that says the same: members one by one, and what they leave of a total."""
        named = [(key, slot, 1, m) for slot, members in enumerate(self.members) for key, seen in members.items() for m in sorted(seen)]
        return [*named, *self._rest()]


class _Running(StatefulProcessor):
    """Counters of a bucket's keys; rows leave with their group's counts so far."""

    def __init__(self, columns: list[str], order: list[str], measures: list[tuple[str, str, str]], inline: int = INLINE):
        self.columns, self.order, self.measures, self.inline = columns, order, measures, inline
        counted = [v for _, fn, v in measures if fn == "count"]
        sets = sorted({v for _, fn, v in measures if fn != "count"})
        #: the slots of a key, by the columns they follow: one per counter, then one per set
        self.slots, self.first_set = [*counted, *sets], len(counted)
        slots = iter(range(len(counted)))
        self.told = [(next(slots) if fn == "count" else self.first_set + sets.index(v), fn == "many") for _, fn, v in measures]
        self.out = Row(*columns, *(out for out, _, _ in measures))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", _LOGGED)
        self.beyond = handle.getMapState("beyond", _MEMBER, StructType([StructField("seen", BooleanType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A block of history: entries of the log, and (``n`` is 0) members that the log does not name."""
        entries = _table_of(initialState["_block"])
        rows = list(zip(*(entries[c].to_pylist() for c in ("_key", "slot", "n", "member"))))
        if logged := [r for r in rows if r[2]]:
            self.log.appendValue(_text_of(logged))
        for own, slot, n, member in rows:
            if not n:
                self.beyond.updateValue((own, slot, member), (True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order))
        counts = self._counted([r["_key"] for r in rows], {c: [r[c] for r in rows] for c in {*self.slots}})
        for r, *told in zip(rows, *counts):
            yield self.out(*(r[c] for c in self.columns), *told)

    def _counted(self, keys: list, values: dict[str, list]) -> list[list]:
        """A column per measure for rows in their order, whose gains are added to the state."""
        if all(own is None for own in keys):
            return [[None] * len(keys) for _ in self.told]
        known, gained, added = _Bucket(len(self.slots), self.log.get()), defaultdict(int), []
        so_far = []
        for slot, column in enumerate(self.slots):
            follow = self._follow_counter if slot < self.first_set else self._follow_set
            so_far.append(follow(known, slot, keys, values[column], gained, added))
        added += [(*at, n, None) for at, n in gained.items()]
        if added:
            if known.entries + len(added) > 2 * known.needed():
                self.log.put([_text_of(known.compact())])
            else:
                self.log.appendList([_text_of(added)])
        return [[n if n is None else n > 1 for n in so_far[slot]] if many else so_far[slot] for slot, many in self.told]

    def _follow_counter(self, known: _Bucket, slot: int, keys: list, values: list, gained: dict, added: list) -> list:
        totals, out = known.totals[slot], []
        for own, value in zip(keys, values):
            if own is None:
                out.append(None)
                continue
            if value is not None:
                totals[own] += 1
                gained[own, slot] += 1
            out.append(totals[own])
        return out

    def _follow_set(self, known: _Bucket, slot: int, keys: list, values: list, gained: dict, added: list) -> list:
        totals, members, out = known.totals[slot], known.members[slot], []
        for own, value in zip(keys, values):
            if own is None:
                out.append(None)
                continue
            if value is not None:
                member, named = str(value), members[own]
                # a total of the named alone says that none lies beyond the log
                if member not in named and (totals[own] == len(named) or not self.beyond.containsKey((own, slot, member))):
                    totals[own] += 1
                    if len(named) < self.inline:
                        named.add(member)
                        added.append((own, slot, 1, member))
                    else:
                        self.beyond.updateValue((own, slot, member), (True,))
                        gained[own, slot] += 1
            out.append(totals[own])
        return out

    def close(self) -> None:
        pass


class _RunningBlocks(_Running):
    """The same for rows that come and leave in blocks."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        table = pa.concat_tables(_table_of(r["_block"]) for r in rows)
        table = table.take(_places(table, self.order))
        values = {c: table[c].to_pylist() for c in {*self.slots}}
        counts = self._counted(table["_key"].to_pylist(), values)
        table = table.select(self.columns)
        for (out, fn, _), told in zip(self.measures, counts):
            table = table.append_column(out, pa.array(told, pa.bool_() if fn == "many" else pa.int64()))
        for batch in table.combine_chunks().to_batches(BLOCK_ROWS):
            yield Row(_block=_block_of(batch))


def _places(table: pa.Table, order: list[str]) -> pa.Array | list[int]:
    """Where the rows stand that come first, second and so on; nulls first, rows of one place as they came."""
    if any(pa.types.is_nested(table.schema.field(c).type) for c in order):
        columns = [table[c].to_pylist() for c in order]
        return sorted(range(len(table)), key=lambda i: tuple((c[i] is not None, c[i]) for c in columns))
    return pc.sort_indices(table, [(c, "ascending") for c in order], null_placement="at_start")


def _block_of(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _table_of(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _in_blocks(df: DataFrame) -> DataFrame:
    """(_bucket, _block): the rows of ``df`` packed by their ``_bucket``, ``BLOCK_BYTES`` at a time."""
    held_bytes = BLOCK_BYTES

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table["_bucket"])).combine_chunks()
        buckets = table["_bucket"].to_numpy()
        ends = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True)) + 1
        rows = table.drop_columns(["_bucket"]).to_batches()[0]
        for at in range(0, len(ends), 1024):
            some = ends[at:at + 1024]
            starts = [ends[at - 1] if at else 0, *some[:-1]]
            blocks = [_block_of(rows.slice(start, end - start)) for start, end in zip(starts, some)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets[some - 1], pa.int32()), pa.array(blocks, pa.binary())], names=["_bucket", "_block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= held_bytes:
                yield from dealt(held)
                held, size = [], 0
        if held:
            yield from dealt(held)

    return df.mapInArrow(run, "_bucket int, _block binary")


def _unpacked(blocks: DataFrame, schema: StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield from _table_of(block.as_py()).to_batches()

    return blocks.mapInArrow(run, schema)


def _bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket")


def _history(df: DataFrame, key: str, measures: list[Measure], inline: int) -> DataFrame:
    """(_bucket, _key, slot, n, member): the counters' starts and the sets' members of ``df``, folded before the shuffle.

    Members beyond the first ``inline`` of a set have ``n`` 0, and one row counts them.
    """
    counted = [m for m in measures if m.fn == "count"]
    sets = sorted({m.value for m in measures if m.fn != "count"})
    known = df.filter(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string"))
    none = F.lit(None).cast("string").alias("member")
    parts = [
        known.groupBy("_key").agg(F.count(m.value).alias("n")).filter("n > 0").select("_key", F.lit(i).alias("slot"), "n", none)
        for i, m in enumerate(counted)
    ]
    for i, v in enumerate(sets, len(counted)):
        members = known.filter(F.col(v).isNotNull()).select("_key", F.lit(i).alias("slot"), F.col(v).cast("string").alias("member")).distinct()
        placed = members.withColumn("place", F.row_number().over(Window.partitionBy("_key").orderBy("member")))
        beyond = F.count(F.when(F.col("place") > inline, 1))
        parts.append(placed.select("_key", "slot", (F.col("place") <= inline).cast("long").alias("n"), "member"))
        parts.append(placed.groupBy("_key", "slot").agg(beyond.alias("n")).filter("n > 0").select("_key", "slot", "n", none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(_bucket_of(F.col("_key")), "_key", "slot", "n", "member")


def running_features(
    stream: DataFrame, names: list[str] | list[Measure], order: list[str], history: DataFrame | None = None, inline: int = INLINE
) -> DataFrame:
    """``stream`` with one column per named group feature, as of each row's arrival.

    ``history`` (a table with the same columns) is counted before the first row of a
    new stream; a restarted one has it in its state. ``inline`` bounds how many members
    of one key's set are read with its bucket.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    by_key: dict[str, list[Measure]] = {}
    for m in (FEATURES[n] if isinstance(n, str) else n for n in names):
        by_key.setdefault(m.key, []).append(m)
    out = stream
    for key, measures in by_key.items():
        columns = out.columns
        text = F.col(key).cast("string")
        # rows without a key are dealt out by their order
        dealt = F.when(text.isNull(), F.xxhash64(*order)).otherwise(F.xxhash64(text))
        kept = out.withColumns({"_key": text, "_bucket": F.pmod(dealt, F.lit(BUCKETS)).cast("int")})
        schema = StructType([*(StructField(f.name, f.dataType) for f in out.schema.fields), *_counted_fields(measures)])
        started = None if history is None else _in_blocks(_history(history, key, measures, inline)).groupBy("_bucket")
        running = _RunningBlocks(columns, order, [(m.out, m.fn, m.value) for m in measures], inline)
        blocks = _in_blocks(kept).groupBy("_bucket").transformWithState(running, "_block binary", "Append", "None", started)
        out = _unpacked(blocks, schema)
    return out
