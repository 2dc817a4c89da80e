"""Merkle manifest, exact dedup and vector codes: brute force and awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fraudloom.llm import anchor_codes, exact_dedup, merkle_manifest
from fraudloom.llm.common import table

UPPER = {c: c + 32 for c in range(65, 91)}
CLASHING = "digest string, copies string, content string, salt string, clash string, id string, leaf string, tree string, pos string, value string"
DOCS = f"doc_id long, source string, lang string, n_chars long, text string, {CLASHING}"
EXTRA = ["x"] * 10


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


@pytest.fixture(scope="module")
def awkward_rows():
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "é", "ß", "İ", "delta"]
    rows = [(i, rng.choice(["s", None]), rng.choice(["en", "de", None, "", "É"]), rng.choice([i, None]), " ".join(rng.choices(words, k=rng.randint(0, 3)))) for i in range(180)]
    rows += [(500, "s", "zz", 1, "Alone"), (None, None, None, None, None), (None, "s", "en", 2, "No id"), (7, "s", "en", 2, "Same id"), (7, "s", "en", 2, "Same id")]
    rows += [(600, "s", "en", 2, None), (601, "s", "en", 2, ""), (602, "s", "en", 120000, "Long TEXT " * 20000), (603, "s", "de", 120000, "long text " * 20000)]
    return rows


# ---- exact dedup ------------------------------------------------------------------


def copies_by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[4] or "").translate(UPPER), []).append(r[0])
    out = []
    for r in rows:
        t = (r[4] or "").translate(UPPER)
        keep = max((i for i in groups[t] if i is not None), default=None)
        out.append((r[0], keep, len(groups[t]), r[0] == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def marked(docs, **kw):
    found, name = exact_dedup.mark_copies(docs, **kw)
    return found, name, sorted((tuple(r) for r in found.select("doc_id", f"{name}.*").collect()), key=repr)


def test_copies_equal_brute_force(spark, awkward_rows):
    docs = docs_of(spark, awkward_rows).repartition(7)
    found, name, rows = marked(docs)
    assert rows == copies_by_hand(awkward_rows)
    assert name not in docs.columns and set(found.columns) == {*docs.columns, name} - {"text"}
    assert marked(docs, keep_text=True, salts=1)[2] == rows


def test_content_decides_where_digests_clash(spark, awkward_rows):
    docs = docs_of(spark, awkward_rows)
    for weak in (lambda t: F.lit("one"), lambda t: F.substring(F.sha2(t, 256), 1, 1)):
        rows = marked(docs, digest=weak)[2]
        assert [r[:4] for r in rows] == [r[:4] for r in copies_by_hand(awkward_rows)]


def test_remove_copies_keeps_the_last_of_each(spark, awkward_rows):
    docs = docs_of(spark, awkward_rows)
    kept = exact_dedup.remove_copies(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    last = {}
    for r in awkward_rows:
        t = (r[4] or "").translate(UPPER)
        last[t] = max(last.get(t, -1), -1 if r[0] is None else r[0])
    want = sorted(repr((r[0], r[4])) for r in awkward_rows if (-1 if r[0] is None else r[0]) == last[(r[4] or "").translate(UPPER)])
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == want


def test_one_content_in_all_rows_and_empty(spark):
    docs = spark.range(20000).repartition(16).select(F.col("id").alias("doc_id"), F.lit("Same Text").alias("text"))
    rows = exact_dedup.mark_copies(docs)[0].select("copies.*").distinct().collect()
    assert {(r["keep_id"], r["group_size"]) for r in rows} == {(19999, 20000)}
    assert exact_dedup.remove_copies(docs).collect() == [(19999, "Same Text")]
    assert exact_dedup.mark_copies(docs.limit(0))[0].count() == 0


def test_copies_run_without_python(spark, sf_dir):
    found, _ = exact_dedup.mark_copies(table(spark, sf_dir, "documents"))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


# ---- Merkle manifest --------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_by_hand(rows):
    def leaf(r, text):
        return H(*map(enc, (r[0], r[1], r[2], r[3], text)))

    trees = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        text = r[4].translate(UPPER) if hit and r[4] is not None else r[4]
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, text), r[0]))
    order = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))

    def climb(nodes):
        """Levels up to the one node left, lowest first."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    low = {}
    for v in order:
        trees[v].sort()
        low[v] = climb([x[2] for x in trees[v]])
    high = climb([low[v][-1][0] for v in order])
    out = []
    for n, v in enumerate(order):
        for i, x in enumerate(trees[v]):
            folded, proof = x[3], ""
            for levels, at in ((low[v], i), (high, n)):
                for level in levels[:-1]:
                    run, slot = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    folded = H(*run[:slot], folded, *run[slot + 1 :])
                    at //= 8
            out.append((x[4], x[2], low[v][-1][0], high[-1][0], H(proof), folded, folded == high[-1][0]))
    return sorted(out, key=repr)


def proven(docs, **kw):
    built = merkle_manifest.build(docs, tampered=merkle_manifest.lowered_where_divisible(), **kw)
    return sorted((tuple(r) for r in merkle_manifest.proofs(built).collect()), key=repr)


def test_proofs_equal_brute_force(spark, awkward_rows):
    got = proven(docs_of(spark, awkward_rows).repartition(5))
    assert got == manifest_by_hand(awkward_rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [
    [(1, "s", "en", 1, "One Leaf")],
    [(i, "s", "en", 1, f"Leaf {i}") for i in range(9)],
    [(i, "s", f"lang{i:02}", 1, f"Leaf {i}") for i in range(11)],
    [(5, "s", "en", 1, "Same")] * 70 + [(6, None, None, None, None)],
])
def test_proofs_of_small_shapes(spark, rows):
    assert proven(docs_of(spark, rows)) == manifest_by_hand(rows)


def test_manifest_of_nothing(spark, awkward_rows):
    empty = docs_of(spark, awkward_rows).limit(0)
    assert proven(empty) == [] and merkle_manifest.build(empty).root is None


def test_untampered_rows_verify_and_nodes_link(spark, awkward_rows):
    built = merkle_manifest.build(docs_of(spark, awkward_rows), fan=3)
    assert merkle_manifest.proofs(built).filter("NOT verified").count() == 0
    ids = built.nodes.select("id").unionByName(built.runs.select("id"))
    assert ids.distinct().count() == ids.count()
    links = built.nodes.select("parent").unionByName(built.runs.select("parent"))
    assert links.filter("parent IS NULL").count() == 1
    assert links.filter("parent IS NOT NULL").join(built.nodes, links["parent"] == built.nodes["id"], "left_anti").count() == 0


# ---- vector codes -----------------------------------------------------------------


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([[int(np.floor(np.float64(np.float32(v)) * 1024)) for v in r[2]] for r in kept], dtype=object)
    cut = np.split(x, parts, axis=1)
    books, codes, errors = [], [], 0
    for p in cut:
        book = p[:entries].copy()
        for step in range(rounds + 1):
            apart = ((p[:, None] - book[None]) ** 2).sum(2)
            at = apart.astype(float).argmin(1)
            if step < rounds:
                for e in set(at.tolist()):
                    book[e] = [s // int((at == e).sum()) for s in p[at == e].sum(0)]
        books.append(book)
        codes.append(at)
        errors = errors + apart[np.arange(len(p)), at]
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    by = {}
    for r, e in zip(kept, errors):
        by[r[1]] = by.get(r[1], 0) + e
    spelled = [bytes(int(c[i]) for c in codes).hex() for i in range(len(kept))]
    return sorted(((r[0], c, int(e), int(by[r[1]])) for r, c, e in zip(kept, spelled, errors)), key=repr), digest


VECTORS = "vec_id long, label int, embedding array<float>, id string, code string, error string, ids string"


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    made = []
    for i in range(n):
        near = rng.normal(0, 0.02, width) + (i % 7) if i % 2 else rng.normal(0, 1, width)
        made.append((i * 3, [None, 0, 1, 2][i % 4], [float(np.float32(v)) for v in near], "x", "x", "x", "x"))
    made += [(9000 + i, 1, made[5][2], "x", "x", "x", "x") for i in range(60)]  # a hot vector
    made += [(None, None, made[6][2], *"xxxx"), (None, 3, made[8][2], *"xxxx"), (3, 1, made[9][2], *"xxxx")]
    bad = [None, [None] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [0.0] * (width - 1) + [float("-inf")]]
    return made + [(-5 - i, 1, v, *"xxxx") for i, v in enumerate(bad)]


@pytest.mark.parametrize("n,width,block,entries", [(400, 8, 64, 256), (700, 4, 4096, 16), (30, 12, 7, 256)])
def test_codes_equal_brute_force(spark, n, width, block, entries):
    rows = vectors(n, n, width)
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    codes = anchor_codes.compress(frame, block=block, entries=entries)
    got = sorted((tuple(r) for r in anchor_codes.with_label_errors(codes).select("id", "code", "error", "label_error").collect()), key=repr)
    want, digest = codes_by_hand(rows, entries=entries)
    assert got == want and codes.digest() == digest


def test_codes_of_nothing_and_of_no_components(spark):
    frame = spark.createDataFrame(vectors(1, 10, 4), VECTORS)
    codes = anchor_codes.compress(frame.limit(0))
    assert anchor_codes.with_label_errors(codes).count() == 0 and codes.books == []
    bare = spark.createDataFrame([(1, 0, []), (2, 0, [])], "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in anchor_codes.compress(bare).rows.select("id", "code", "error").collect()] == [(1, "00000000", 0), (2, "00000000", 0)]


def test_codes_refuse_what_they_cannot_cut(spark):
    odd = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0])], "vec_id long, label int, embedding array<float>")
    with pytest.raises(ValueError, match="equal parts"):
        anchor_codes.compress(odd)
    far = spark.createDataFrame([(1, 0, [1e30] * 4)], "vec_id long, label int, embedding array<float>")
    with pytest.raises(ValueError, match="too large"):
        anchor_codes.compress(far)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 40), st.integers(0, 4), st.integers(1, 9))
def test_trees_find_the_nearest_entries(seed, n, k, width, leaf):
    rng = np.random.default_rng(seed)
    points = rng.integers(-3, 4, (n, width)).astype(float) * rng.integers(1, 50)
    book = rng.integers(-3, 4, (k, width)).astype(float) * rng.integers(1, 50)
    if seed % 3 == 0:
        points[n // 3 :] = points[0]
    tree = anchor_codes.build_tree(points, leaf)
    apart = ((points[:, None] - book[None]) ** 2).sum(2)
    at, error = anchor_codes.entries_of(tree, book)
    assert (at == apart.argmin(1)).all() and (error == apart.min(1)).all()
    sums, counts = anchor_codes.entry_sums(tree, book)
    assert (counts == np.bincount(at, minlength=k)).all()
    assert all((sums[i] == points[at == i].sum(0)).all() for i in range(k))


def test_balls_hold_their_points_and_lone_owners_are_not_read():
    rng = np.random.default_rng(4)
    places = rng.integers(-40, 40, (12, 4)) * 1000.0
    points = places[rng.integers(0, 12, 2000)] + rng.integers(-20, 21, (2000, 4))
    tree = anchor_codes.build_tree(points)
    for a, b, c, r, s in zip(tree.first, tree.last, tree.centre, tree.radius, tree.sums):
        assert np.sqrt(((tree.points[a:b] - c) ** 2).sum(1)).max() <= r + 1e-9 and (tree.points[a:b].sum(0) == s).all()
    assert sorted(tree.order.tolist()) == list(range(2000))
    owned = sum(b - a for a, b, ball, _ in anchor_codes.walk(tree, places) if ball >= 0)
    assert owned == 2000  # clusters far apart: every point is added from a cached ball
