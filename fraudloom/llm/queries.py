"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.llm import (
    anchor_codes,
    decontaminate,
    exact_dedup,
    license_join,
    merkle_manifest,
    minhash_hamming,
    packed_ids,
    pu_quality,
    quality_rules,
    secret_scan,
    suffix_dedup,
    toxicity,
    wfst_pieces,
)
from fraudloom.llm.common import held_out, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: Moments, prior and verdicts as in quality_rules; the limits are its defaults.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM g),
c AS (SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS inside FROM h WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, count(*) FILTER (WHERE inside) AS n_repeat_words FROM c GROUP BY r),
per AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id, d.source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN per USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (100 * n_symbols > 30 * n_words)::INT + (100 * n_dup_lines > 30 * n_lines)::INT
    + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS failures
  FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed OR failures > 0)::DOUBLE AS failed FROM f GROUP BY source),
s AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(failed) AS failed, sum(failed * failed / n) AS square, sum(n * n) AS nn FROM hosts),
p AS (SELECT *, least(greatest(failed / n, 1 / (n + 2)), 1 - 1 / (n + 2)) AS mean FROM s),
q AS (SELECT *, (square - n * (failed / n) * (failed / n) - (k - 1) * mean * (1 - mean)) / greatest(n - nn / n - (k - 1), 1e-9) / (mean * (1 - mean)) AS share FROM p),
z AS (SELECT *, greatest(CASE WHEN k > 1 AND share > 0 AND share < 1 THEN 1 / share - 1 ELSE n / k END, 1e-3) AS weight FROM q),
poor AS (SELECT source, (hosts.failed + z.mean * weight) / (hosts.n + weight) >= 0.5 AS poor FROM hosts, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failures <= CASE WHEN poor THEN 0 ELSE 1 END AS kept
FROM f JOIN poor ON f.source IS NOT DISTINCT FROM poor.source
"""


@query(OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged, name = quality_rules.judge(docs, keep_text=False)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"{name}.{f}").alias(f) for f in fields))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
pair AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, least) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT pair.b, reach.least FROM reach JOIN pair ON pair.a = reach.node WHERE reach.least < pair.b),
c AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""


@query(OP6_SQL)
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_hamming.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g
  FROM d, sizes WHERE len(w) >= size),
h AS (SELECT r, i, dw.size, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size),
p AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT r, i, size FROM h)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN it USING (r)
"""


@query(OP4_SQL)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, f = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col(f"{f}.n_words").alias("n_words"), F.size(f"{f}.hit").cast("long").alias("n_hit"),
        F.size(f"{f}.items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col(f"{f}.items")).alias("items_sha256"),
        decontaminate.contaminated(f).alias("contaminated"),
    )


@query()
def op10_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = wfst_pieces.encoded_digests(docs)
    return found.select("doc_id", f"{name}.*")


@query()
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(F.col(name), lambda s: s["rank"] < 3)
    # a lambda of two parameters would get the position as the second
    of_kind = lambda r: F.filter(F.col(name), lambda s: s["rank"] == r)
    counts = [F.size(of_kind(r)).cast("long").alias(f"n_{k}") for r, k in enumerate(secret_scan.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.spelled(base), 256).alias("base_sha256"), secret_scan.spelled(F.col(name)).alias("spans")
    )


@query()
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, p, b = license_join.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, matches = F.col(f"{p}.base_labels"), F.col(f"{b}.matches")
    labels = F.array_sort(F.array_union(base, F.transform(matches, lambda m: m["label"])))
    best = F.array_max(F.transform(matches, lambda m: m["shared"] / m["size"]))
    return found.select(
        "doc_id", *(F.col(f"{p}.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


@query()
def op7_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.encoded_digests(table(spark, sf_dir, "documents"))


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pu_quality.train(docs, table(spark, sf_dir, "labels"))
    scored, name = pu_quality.score(docs, model)
    score = F.col(f"{name}.score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored, name = toxicity.score(docs, model)
    score = F.col(f"{name}.score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


OP12_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


@query(OP12_SQL)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, name = exact_dedup.mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select(
        "doc_id", *(F.col(f"{name}.{c}").alias(c) for c in ("keep_id", "group_size", "kept")), F.col(f"{name}.digest").alias("text_sha256")
    )


#: CRC-32 bit by bit: a byte enters as 256 + its value, then come eight shifts.
OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    coalesce(xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
      string_split(doc_id::VARCHAR, ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: CASE WHEN x >= 256 THEN xor(c, x - 256) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 3 = 0, false) AS hit
  FROM documents),
e AS (
  SELECT lang, doc_id, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
    coalesce(strlen(text) || ':' || text, '-') AS body, CASE WHEN hit THEN coalesce(strlen(text) || ':' || lowered, '-') END AS other
  FROM d),
h AS (SELECT lang, doc_id, sha256(front || body) AS leaf, sha256(front || coalesce(other, body)) AS claim FROM e),
langs AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM h GROUP BY lang),
leaves AS (
  SELECT tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, doc_id, leaf, claim
  FROM h JOIN langs ON h.lang IS NOT DISTINCT FROM langs.lang),
low(tree, level, n, pos, hash) AS (
  SELECT tree, 0, n, pos, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, (n + 7) // 8, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, n, pos // 8),
subroots AS (SELECT tree, hash FROM low WHERE n = 1),
high(level, n, pos, hash) AS (
  SELECT 0, (SELECT count(*) FROM subroots), tree, hash FROM subroots
  UNION ALL
  SELECT level + 1, (n + 7) // 8, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, n, pos // 8),
nodes AS (SELECT tree, level, n, pos, hash FROM low UNION ALL SELECT -1, level, n, pos, hash FROM high),
runs AS (SELECT tree, level, pos // 8 AS run, list(hash ORDER BY pos) AS hashes FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8),
climb(first_tree, first_pos, tree, level, n, pos, proof, folded) AS (
  SELECT tree, pos, tree, 0, n, pos, '', claim FROM leaves
  UNION ALL
  SELECT first_tree, first_pos, step.tree, step.level, step.n, step.pos, step.proof, step.folded FROM (
    SELECT first_tree, first_pos, c.tree, c.level + 1 AS level, (n + 7) // 8 AS n, pos // 8 AS pos,
      proof || array_to_string(hashes[:pos % 8], '') || array_to_string(hashes[pos % 8 + 2:], '') AS proof,
      sha256(array_to_string(hashes[:pos % 8], '') || folded || array_to_string(hashes[pos % 8 + 2:], '')) AS folded
    FROM climb c JOIN runs ON runs.tree = c.tree AND runs.level = c.level AND run = pos // 8 WHERE n > 1
    UNION ALL
    SELECT first_tree, first_pos, -1, 0, (SELECT count(*) FROM subroots), tree, proof, folded FROM climb WHERE n = 1 AND tree >= 0) step),
ends AS (SELECT first_tree, first_pos, proof, folded FROM climb WHERE tree = -1 AND n = 1)
SELECT doc_id, leaf, s.hash AS subroot, r.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.hash AS verified
FROM leaves l JOIN ends ON first_tree = l.tree AND first_pos = l.pos JOIN subroots s ON s.tree = l.tree, (SELECT hash FROM high WHERE n = 1) r
"""


@query(OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    built = merkle_manifest.build(docs, tampered=merkle_manifest.lowered_where_divisible())
    return merkle_manifest.proofs(built).withColumnRenamed("id", "doc_id")


def _codebook_sql(rounds: int) -> str:
    """One pair of steps per round: nearest entries, then floored means; entries without parts stay."""
    steps = """
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS w FROM kept, (SELECT unnest(range(4)) AS part)),
b0 AS (SELECT part, r AS entry, w FROM p WHERE r < 256)"""
    near = """,
a{n} AS (
  SELECT r, p.part, min(struct_pack(d := list_dot_product(p.w, p.w) - 2 * list_dot_product(p.w, b.w) + list_dot_product(b.w, b.w), e := b.entry)) AS best
  FROM p JOIN b{n} b ON b.part = p.part GROUP BY r, p.part)"""
    mean = """,
m{n} AS (
  SELECT part, entry, list(m ORDER BY i) AS w FROM (
    SELECT part, entry, i, floor(sum(x) / count(*)) AS m
    FROM (SELECT p.part, best.e AS entry, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p JOIN a{n} a ON a.r = p.r AND a.part = p.part)
    GROUP BY part, entry, i) GROUP BY part, entry),
b{k} AS (SELECT b.part, b.entry, coalesce(m.w, b.w) AS w FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry)"""
    for n in range(rounds):
        steps += near.format(n=n) + mean.format(n=n, k=n + 1)
    return steps + near.format(n=rounds) + f""",
c AS (SELECT r, string_agg(lower(printf('%02x', best.e)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS digest FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM kept JOIN c USING (r), books
"""


@query(_codebook_sql(anchor_codes.ROUNDS))
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = anchor_codes.compress(table(spark, sf_dir, "embeddings"))
    return anchor_codes.with_label_errors(codes).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256")
    )
