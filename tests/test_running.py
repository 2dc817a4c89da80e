"""Counts that follow the stream: restarts, history, late rows, null keys and scoring on arrival."""

import os
import random
from datetime import date

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fraudloom.operators import feature_sets
from fraudloom.operators.key_tables import Measure
from fraudloom.sources import fixtures as fx
from fraudloom.streaming import running, scoring
from fraudloom.streaming.running import running_features

OF_USER = [
    Measure("events_of_user", "user_id", "count", "event_id"), Measure("kinds_of_user", "user_id", "distinct", "event_type"),
    Measure("many_kinds", "user_id", "many", "event_type"),
]


def drain(stream, folder):
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    assert writer.trigger(availableNow=True).outputMode("append").start().awaitTermination(240)


def rows_of(spark, folder, *columns):
    return sorted(map(tuple, spark.read.parquet(f"{folder}/rows").select(*columns).collect()))


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The events in ten files of consecutive times, one micro-batch each."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = fx.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").toPandas().sort_values(["ts", "event_id"])
    size = -(-len(events) // 10)
    for i in range(10):
        path = f"{folder}/part{i}.parquet"
        events[i * size : (i + 1) * size].to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


def stream(spark, folder, glob="*.parquet"):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", glob).parquet(folder)


def wanted(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    cur = con.execute(entry.oracle_sql()["stream_running_counts"])
    names = [d[0] for d in cur.description]
    return sorted(tuple(r[names.index(c)] for c in ("event_id", "events_of_user", "kinds_of_user", "many_kinds")) for r in cur.fetchall())


COLUMNS = ("event_id", "events_of_user", "kinds_of_user", "many_kinds")


def test_ten_batches_with_restarts_equal_the_windows(spark, sf_dir, parts, tmp_path):
    for glob in ("part[0-2].parquet", "part[0-6].parquet", "part?.parquet"):  # each run goes on where the last one stopped
        drain(running_features(stream(spark, parts, glob), OF_USER, ["ts", "event_id"]), str(tmp_path))
    assert rows_of(spark, tmp_path, *COLUMNS) == wanted(sf_dir)


def test_history_counts_before_the_stream(spark, sf_dir, parts, tmp_path):
    old = spark.read.parquet(*(f"{parts}/part{i}.parquet" for i in range(6)))
    new = stream(spark, parts, "part[6-9].parquet")
    drain(running_features(new, OF_USER, ["ts", "event_id"], history=old), str(tmp_path))
    got = rows_of(spark, tmp_path, *COLUMNS)
    later = {r[0] for r in got}
    assert len(got) == spark.read.parquet(*(f"{parts}/part{i}.parquet" for i in range(6, 10))).count()
    assert got == [r for r in wanted(sf_dir) if r[0] in later]


def test_null_keys_and_null_members(spark, tmp_path):
    rows = [(i, i % 3 if i % 5 else None, "x" if i % 2 else None) for i in range(40)]
    spark.createDataFrame(rows, "id long, k long, m string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, k long, m string").parquet(str(tmp_path / "in"))
    measures = [Measure("n", "k", "count", "m"), Measure("d", "k", "distinct", "m"), Measure("id_n", "m", "count", "id")]
    drain(running_features(source, measures, ["id"]), str(tmp_path))
    want, seen, of_m = [], {}, {}
    for i, k, m in rows:
        if k is not None:
            seen.setdefault(k, []).append(m)
        known = [x for x in seen.get(k, []) if x is not None]
        if m is not None:
            of_m[m] = of_m.get(m, 0) + 1
        want.append((i, None if k is None else len(known), None if k is None else len(set(known)), of_m.get(m) if m else None))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "rows")).select("id", "n", "d", "id_n").orderBy("id").collect()] == want


def test_cards_are_scored_as_of_their_arrival(spark, sf_dir, tmp_path):
    cards = fx.transactions(spark, sf_dir)
    old, new = cards.filter("id % 10 > 0"), cards.filter("id % 10 = 0")
    live = ["transactions_per_card", "users_per_card", "cards_per_customer"]
    detector = scoring.fit_detector(old, feature_sets.FOREST, date(2024, 6, 15), n_estimators=20)
    model, stored = str(tmp_path / "model"), str(tmp_path / "cards")
    scoring.save_model(detector, spark, model)
    new.coalesce(1).write.parquet(stored)
    source = spark.readStream.schema(cards.schema).parquet(stored)
    run = scoring.start_scoring(
        source, model, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True, live=live, order=["id"], history=old
    )
    assert run.awaitTermination(240)
    got = {(r["id"], r["user_id"]): round(r["anomaly_score"], 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # the same by hand: counts over history and the rows so far
    all_rows = cards.select("id", "user_id", "card_number", "customer_id").toPandas().sort_values("id")
    old_ids = all_rows["id"] % 10 > 0
    counts = []
    for r in all_rows[~old_ids].itertuples():
        so_far = all_rows[old_ids | (all_rows["id"] <= r.id)]
        card = so_far[so_far["card_number"] == r.card_number] if r.card_number else None
        customer = so_far[so_far["customer_id"] == r.customer_id] if r.customer_id else None
        counts.append((int(r.id), None if card is None else len(card), None if card is None else int(card["user_id"].nunique()),
                       None if customer is None else int(customer["card_number"].nunique())))
    carried = spark.createDataFrame(counts, "id long, " + ", ".join(f"{c} long" for c in live))
    want = detector.score(new.join(carried, "id"), live=live).collect()
    assert got == {(r["id"], r["user_id"]): round(r["anomaly_score"], 9) for r in want}
    plain = {(r["id"], r["user_id"]): round(r["anomaly_score"], 9) for r in detector.score(new).collect()}
    assert got != plain


class CountedState:
    """List and map state in memory that counts its calls."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def getListState(self, name, schema):
        return self._state(name, [])

    def getMapState(self, name, key, value):
        return self._state(name, {})

    def _state(self, name, start):
        outer, held = self, self.held.setdefault(name, start)

        class State:
            def __getattribute__(self, call):
                outer.calls += 1
                return {
                    "get": lambda: iter(list(held)), "appendList": lambda more: held.extend(more),
                    "put": lambda new: held.__setitem__(slice(None), new), "appendValue": lambda one: held.append(one),
                    "containsKey": lambda k: k in held, "updateValue": lambda k, v: held.__setitem__(k, v),
                }[call]

        return State()


@pytest.mark.parametrize("inline", [2, 1000])
def test_a_bucket_reads_and_writes_its_state_once(inline):
    rng = random.Random(8)
    rows = [Row(id=i, k=None if i % 17 == 0 else f"k{rng.randint(0, 40)}", v=rng.choice([None, 1, 2, 3, 4, 5, 6]), _key=None) for i in range(900)]
    rows = [Row(**{**r.asDict(), "_key": r.k}) for r in rows]
    state = CountedState()
    counter = running._Running(["id"], ["id"], [("n", "count", "v"), ("d", "distinct", "v"), ("many", "many", "v")], inline)
    got = []
    for first in range(0, 900, 90):  # ten micro-batches, their rows out of order
        counter.init(state)
        batch = rows[first : first + 90]
        before = state.calls
        got += counter.handleInputRows((0,), iter(rng.sample(batch, 90)), None)
        if inline == 1000:
            assert state.calls - before <= 2
    want, seen = [], {}
    for r in rows:
        mine = seen.setdefault(r.k, [])
        mine += [r.v] if r.v is not None else []
        want.append((r.id, None, None, None) if r.k is None else (r.id, len(mine), len(set(mine)), len(set(mine)) > 1))
    assert [tuple(g) for g in got] == want
    assert len(state.held["log"]) <= 2 * (41 * (min(inline, 6) + 2)) and bool(state.held["beyond"]) == (inline == 2)


def test_sets_beyond_the_log_follow_history_and_rows(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", str(i % 23), i % 4 or None) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, k string, v string, w long")
    of_k = [Measure("n", "k", "count", "w"), Measure("d", "k", "distinct", "v"), Measure("e", "k", "distinct", "w")]
    frame.filter("id >= 100").coalesce(1).write.parquet(f"{tmp_path}/in")
    streamed = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    drain(running_features(streamed, of_k, ["id"], frame.filter("id < 100"), inline=3), tmp_path)
    want = []
    for i, k, _, _ in rows[100:]:
        mine = [r for r in rows[: i + 1] if r[1] == k]
        want.append((i, sum(r[3] is not None for r in mine), len({r[2] for r in mine}), len({r[3] for r in mine} - {None})))
    assert rows_of(spark, str(tmp_path), "id", "n", "d", "e") == want


def test_blocks_of_rows_are_counted_as_the_rows_are():
    rng = random.Random(3)
    rows = [
        Row(id=i if i % 40 else None, at=i % 7, k=None if i % 11 == 0 else f"k\u00e9{rng.randint(0, 9)}", v=rng.choice([None, 1, 2, 3]), d=date(2024, 1, 1 + i % 28))
        for i in range(600)
    ]
    rows = [Row(**{**r.asDict(), "_key": r.k}) for r in rows]
    measures = [("n", "count", "v"), ("d_of_k", "distinct", "d"), ("many", "many", "v")]
    plain, packed = (made(["id", "d", "k"], ["at", "id"], measures, 5) for made in (running._Running, running._RunningBlocks))
    of_rows, of_blocks = CountedState(), CountedState()
    plain.init(of_rows)
    packed.init(of_blocks)
    for first in (0, 200, 400):  # three micro-batches, each of two blocks
        batch = rows[first : first + 200]
        tables = [pa.RecordBatch.from_pylist([r.asDict() for r in part]) for part in (batch[:150], batch[150:])]
        left = list(packed.handleInputRows((0,), iter([Row(_block=running._block_of(t)) for t in tables]), None))
        assert len(left) == 1
        got = [tuple(r.values()) for r in running._table_of(left[0]["_block"]).to_pylist()]
        assert got == [tuple(r) for r in plain.handleInputRows((0,), iter(batch), None)]
        # what a micro-batch adds to a bucket is one entry of its log, however many keys gained
        assert len(of_blocks.held["log"]) <= 1 + first // 200
    assert of_blocks.held == of_rows.held and of_blocks.held["beyond"]


def test_rows_reach_the_state_packed_by_bucket(spark, monkeypatch):
    rows = [(i, f"k{i % 30}" if i % 9 else None, str(i % 4)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, k string, v string")
    blocks = running._in_blocks(frame.withColumn("_bucket", F.pmod(F.xxhash64("k"), F.lit(8)).cast("int")).coalesce(1)).collect()
    assert len(blocks) == len({r["_bucket"] for r in blocks})
    back = [tuple(r.values()) for b in blocks for r in running._table_of(b["_block"]).to_pylist()]
    assert sorted(back) == rows
    monkeypatch.setattr(running, "BLOCK_BYTES", 1)  # every batch is dealt by itself
    many = running._in_blocks(frame.withColumn("_bucket", F.lit(3)).repartition(2)).collect()
    assert sorted(r["id"] for b in many for r in running._table_of(b["_block"]).to_pylist()) == list(range(3000))
    assert {r["_bucket"] for r in many} == {3}
