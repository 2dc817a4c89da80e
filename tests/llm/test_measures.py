"""Held-out quality of the classifiers, gradients by differences, very long texts, long items and long pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.llm import (
    anchor_codes, decontaminate, exact_dedup, license_join, merkle_manifest, minhash_hamming, packed_ids, pu_quality, quality_rules,
    secret_scan, suffix_dedup, toxicity, wfst_pieces,
)
from fraudloom.llm import queries
from fraudloom.llm.common import parts_by_bytes, plain_words, table

from .test_text_operators import brute_rules, brute_windows, unigram_model

SF = "/root/testdata/sf0.1"


def area(scores, labels):
    """Share of pairs of a good and a bad row that the scores order rightly."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for s in np.unique(scores):
        ranks[scores == s] = ranks[scores == s].mean()
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize("name,label,cut,least_area,least_recall", [
    ("op2_quality_classifier", "quality", 0.3, 0.95, 0.95), ("op8_toxicity", "toxic", 0.5, 0.9, 0.7),
])
def test_held_out_quality(spark, name, label, cut, least_area, least_recall):
    scored = queries.QUERIES[name](spark, SF)
    known = scored.filter("held_out").join(table(spark, SF, "labels").filter(F.col(label).isNotNull()), "doc_id").select("score", label).toPandas()
    s, y = known["score"].to_numpy(), known[label].to_numpy()
    assert len(s) > 50 and (y == 1).any() and (y == 0).any()
    assert area(s, y) >= least_area and ((s >= cut) & (y == 1)).sum() / (y == 1).sum() >= least_recall
    assert ((s < cut) & (y == 0)).sum() / (y == 0).sum() >= 0.9


@pytest.fixture(scope="module")
def long_docs(spark):
    """One text of 20,000 words among 1,000 short ones, all in one partition and batch."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=20_000))
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(1000)]
    texts[500] = long
    texts[900] = long[: len(long) // 2] + " and something else " + long[len(long) // 2 :]
    rows = [(i, t, "en", "s", len(t), *["x"] * 6) for i, t in enumerate(texts)]
    clashing = "near string, kept string, s string, key string, words_md5 string, spans string"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}").coalesce(1), texts


def test_very_long_texts(spark, long_docs):
    docs, texts = long_docs
    near = {r.doc_id: r.component_id for r in minhash_hamming.near_duplicates(docs).collect()}
    assert near[900] == near[500] == 500 and sum(k != v for k, v in near.items()) == 1
    assert minhash_hamming.keep_one(docs).columns == docs.columns
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[900].n_removed > 0.9 * len(texts[500]) and cut[500].n_removed == 0
    items = [("half", " ".join(texts[500].split()[9_000:11_500])), ("short", "and something else")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (decontaminate.BLOCK_WINDOWS, 700):  # the first item is then longer than a block
        found, name = decontaminate.find_windows(docs.filter("doc_id > 497 AND doc_id < 503 OR doc_id = 900"), bench, block_windows=block)
        for r in found.select("doc_id", f"{name}.*").collect():
            if r.doc_id == 500:
                assert len(r.hit) == 2500 and r.items == ["half"]
            elif r.doc_id == 900:
                assert len(r.hit) >= 2490 and r.items == ["half", "short"]
            else:
                assert (r.n_words, r.hit, r.items) == brute_windows(texts[r.doc_id], items)
    judged, name = quality_rules.judge(docs)
    row = judged.filter("doc_id = 500").select(f"{name}.*").first()
    assert row.n_words == 20_000 == brute_rules(texts[500])[0]
    assert secret_scan.redact(docs).filter("doc_id = 500").first().text == texts[500]
    assert license_join.scan(docs)[0].count() == len(texts)
    ids = {r.doc_id: r.n_tokens for r in packed_ids.encoded_digests(docs).collect()}
    assert ids[500] > 20_000
    encoded, name = wfst_pieces.encoded_digests(docs)
    assert encoded.filter(f"NOT {name}.round_trip").count() == 0
    assert exact_dedup.remove_copies(docs).count() == len(set(texts))
    assert merkle_manifest.proofs(merkle_manifest.build(docs)).filter("verified").count() == len(texts)


def test_items_longer_than_a_block_lose_no_window():
    words = [f"w{i}".encode() for i in range(50)]
    whole = decontaminate.WindowSet.of([("a", words)], 13)

    class Rows:
        def select(self, *_):
            return self

        def toLocalIterator(self):
            return iter([("a", b" ".join(words).decode()), ("b", "w1 w2")])

    blocks = list(decontaminate.window_blocks(Rows(), "x", "y", 13, 5))
    seen = set().union(*(b.windows.get(13, {}) for b in blocks))
    assert seen == set(whole.windows[13]) and sum(len(b.windows.get(2, {})) for b in blocks) == 1
    assert max(sum(map(len, b.windows.values())) for b in blocks) <= 5


def test_a_piece_of_a_hundred_characters():
    long = "ab" * 50
    t = wfst_pieces.Transducer(unigram_model([("<unk>", 0, 2), ("▁", -2, 1), ("a", -3, 1), ("b", -3, 1), (long, -1, 1)]))
    assert t.path("▁" + long) == ["▁", long] and t.path("▁a" + long + "b") == ["▁", "a", long, "b"]


def test_swap_gradient_equals_differences():
    """The fitted weights are a minimum of the stated loss: differences in any direction do not lower it."""
    rng = np.random.default_rng(1)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(80)]
    y = np.array([float(0 in r) for r in rows])
    pairs = [(r, sorted(set(r) ^ {1, 2})) for r in rows if 1 in r and 2 not in r]
    weight = np.ones(len(y))
    w, bias = toxicity.fit(rows, y, weight, pairs, 6, 1.0)

    def loss(w, bias):
        z = np.array([w[r].sum() + bias for r in rows])
        change = np.array([w[a].sum() - w[b].sum() for a, b in pairs])
        return float(np.mean(np.logaddexp(0, z) - y * z) + np.mean(change**2))

    base = loss(w, bias)
    for i in range(6):
        for step in (0.5, -0.5):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, bias) > base - 1e-2
    assert abs(w[1] - w[2]) < 0.3


def test_quality_does_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(6)
    good, mixed = rng.normal(0, 1, (1500, len(pu_quality.NAMES))), rng.normal(0, 1, (1200, len(pu_quality.NAMES)))
    mixed[800:] += 2.5
    priors = [pu_quality.fit(good, mixed[p]).prior for p in (np.arange(1200), rng.permutation(1200))]
    assert priors == pytest.approx([2 / 3, 2 / 3], abs=0.08)


def test_parts_by_bytes():
    texts = [b"a" * n for n in (3, 4, 0, 100, 1, 9)]
    parts = list(parts_by_bytes(texts, 10))
    assert [x for p in parts for x in p] == texts and [sum(map(len, p)) for p in parts] == [7, 100, 10]
    assert list(parts_by_bytes([], 10)) == [] and plain_words(b"A-b") == [b"a", b"b"] and anchor_codes.PARTS == 4
