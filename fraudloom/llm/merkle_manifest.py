"""Merkle manifest of a table: levels of stored, parent-linked nodes and a recursive climb.

A row's leaf is H of its encoded columns; H is the lowercase hex SHA-256 of its inputs,
concatenated, digests as hex text (stored as 32 bytes). Rows of one ``tree_by`` value
form a tree: leaves ascend by ``order_by``, and every ``fan`` consecutive nodes become
their H until one, the subroot, is left. Subroots, ordered by their tree's value, form
the root tree in the same way.

* Leaves are numbered by a distributed sort, never by a window over a tree; a level is
  one aggregation whose groups hold at most ``fan`` nodes, and is written as a table of
  nodes with links to their parents. Levels grow with the logarithm of the rows.
* Proofs come from one recursive query over those tables. Its rows are the lowest runs:
  the leaves of a run climb side by side, each folding its own claimed hash, while the
  siblings above the run, which they share, are appended once. What an iteration moves
  is therefore an eighth of a proof per leaf. Iterations materialise as shuffles, which
  are rebuilt from their lineage when an executor is lost.

Results on awkward input: a null column encodes as ``-`` and an empty text as ``0:``.
Null trees and null order values come first; rows of equal order value are ordered by
their leaf, and identical rows stand side by side, each with its own proof. A tree of
one row is its own subroot, a manifest of one tree has its subroot as root, and a proof
without siblings is H of nothing. An empty table gives an empty result. Columns that are
not encoded are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.exact_dedup import lower_ascii
from fraudloom.operators.numbering import number_rows
from fraudloom.plans.sizing import KeyProfile, hot_share, join_back
from fraudloom.session import cut_lineage

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """H of texts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def spelled(value: Column) -> Column:
    return F.lower(F.hex(value))


def lowered_where_divisible(docs_id: str = "doc_id", text: str = "text") -> tuple[Column, dict[str, Column]]:
    """The tampering of the registered query: texts lose their capitals where 3 divides the id's checksum."""
    hit = F.coalesce(F.crc32(F.col(docs_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return hit, {text: lower_ascii(F.col(text))}


@dataclass(frozen=True)
class Manifest:
    """The stored tables: ``runs`` (lowest runs with their leaves), ``nodes`` (all above) and the root's hex digest."""

    runs: DataFrame
    nodes: DataFrame
    root: str | None


def build(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    tree_by: str = "lang",
    order_by: str = "doc_id",
    tampered: tuple[Column, dict[str, Column]] | None = None,
    fan: int = FAN,
) -> Manifest:
    """Hash the rows and build all levels.

    ``tampered`` is (where, {column: other value}): rows claimed to hold other values
    than those that the manifest is built from. Claims are stored beside the leaves
    and never enter a node.
    """
    leaf = digest(*(encoded(F.col(c)) for c in columns))
    claim = leaf
    if tampered:
        where, values = tampered
        claim = F.when(where, digest(*(encoded(values.get(c, F.col(c))) for c in columns))).otherwise(leaf)
    leaves = cut_lineage(docs.select(
        F.col(tree_by).alias("value"), encoded(F.col(tree_by)).alias("tree_key"), F.col(order_by).alias("id"),
        leaf.alias("leaf"), claim.alias("claim"), F.monotonically_increasing_id().alias("row"),
    ))
    numbered = number_rows(leaves, ["value", "id", "leaf", "row"], "at")
    trees = number_rows(numbered.groupBy("tree_key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size")), ["first"], "tree")
    trees = cut_lineage(trees.select("tree_key", "tree", "first", "size"))
    count, total, longest, width = trees.agg(
        F.count(F.lit(1)), F.sum("size"), F.max("size"), F.max(F.octet_length("tree_key"))
    ).first()
    if not count:
        return Manifest(_no_runs(leaves, fan), _no_nodes(leaves), None)

    least = max(int(total * hot_share(docs.sparkSession)), 1)
    hot = tuple(r["tree_key"] for r in trees.filter(F.col("size") >= least).select("tree_key").collect())
    placed = join_back(
        numbered.drop("value"), trees, "tree_key", KeyProfile(count, width, hot), ["at"]
    ).withColumn("pos", F.col("at") - F.col("first"))
    members = F.sort_array(F.collect_list(F.struct((F.col("pos") % fan).cast("int").alias("slot"), "id", "leaf", "claim")))
    runs = placed.groupBy("tree", "size", F.floor(F.col("pos") / fan).alias("pos")).agg(members.alias("leaves"))
    whole = digest(F.array_join(F.transform("leaves", lambda x: spelled(x["leaf"])), ""))
    lone = F.col("size") == 1
    runs = cut_lineage(runs.select(
        "tree", "pos", F.ceil(F.col("size") / fan).alias("size"), "leaves",
        F.when(lone, F.col("leaves")[0]["leaf"]).otherwise(whole).alias("hash"), lone.alias("lone"),
    ))

    lowest = runs.select("tree", "pos", "size", "hash")
    upper = _levels(lowest, _ceil_div(longest, fan), fan)
    tops = cut_lineage(reduce(DataFrame.unionByName, [
        x.filter("size = 1").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("size"), "hash")
        for x in (lowest, *upper)
    ]))
    crown = _levels(tops, count, fan)
    top = crown[-1] if crown else tops
    root = top.filter("size = 1").select(spelled(F.col("hash")).alias("root")).first()["root"]
    nodes = [_linked(x, "t", n, count, fan) for n, x in enumerate(upper, 2)]
    nodes += [_linked(x, "r", n, 1, fan) for n, x in enumerate(crown, 1)]
    linked = reduce(DataFrame.unionByName, nodes) if nodes else _no_nodes(leaves)
    return Manifest(_linked(runs, "t", 1, count, fan), cut_lineage(linked), root)


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def _levels(lowest: DataFrame, longest: int, fan: int) -> list[DataFrame]:
    """Written node tables above (tree, pos, size, hash), one per level; trees that are down to one node stop."""
    found, below = [], lowest
    while longest > 1:
        longest = _ceil_div(longest, fan)
        children = F.sort_array(F.collect_list(F.struct("pos", "hash")))
        level = (
            below.filter("size > 1").withColumn("up", F.floor(F.col("pos") / fan))
            .groupBy("tree", "up", F.ceil(F.col("size") / fan).alias("size")).agg(children.alias("children"))
        )
        joined = F.array_join(F.transform("children", lambda x: spelled(x["hash"])), "")
        below = cut_lineage(level.select(
            "tree", F.col("up").alias("pos"), "size", digest(joined).alias("hash"), F.unhex(joined).alias("children")
        ))
        found.append(below)
    return found


def _linked(nodes: DataFrame, kind: str, level: int, trees: int, fan: int) -> DataFrame:
    """``nodes`` with their id, their parent's id, their slot under it, and the subroot if a tree ends here."""
    def name(k, n, tree, pos):
        return F.concat_ws("/", F.lit(k), F.lit(n), tree.cast("string"), pos.cast("string"))

    def place(x):
        return F.floor(x / fan), (x % fan).cast("int")

    (up, slot), (tree_up, tree_slot) = place(F.col("pos")), place(F.col("tree"))
    inside = F.col("size") > 1
    parent, at = F.when(inside, name(kind, level + 1, F.col("tree"), up)), F.when(inside, slot)
    if kind == "t" and trees > 1:
        parent = F.coalesce(parent, name("r", 1, F.lit(0), tree_up))
        at = F.coalesce(at, tree_slot)
    subroot = F.when(F.lit(kind == "t") & ~inside, F.col("hash"))
    kept = [c for c in ("leaves", "lone", "children") if c in nodes.columns]
    return nodes.select(
        name(kind, level, F.col("tree"), F.col("pos")).alias("id"), parent.alias("parent"), at.alias("slot"), subroot.alias("subroot"), *kept
    )


#: A run's leaves climb together; siblings left and right of the child they came from join the path.
#: The nodes grow with the table, so they are never broadcast.
CLIMB = """
WITH RECURSIVE climb(id, parent, slot, subroot, folded, path) AS (
  SELECT id, parent, slot, subroot, folded, path FROM {anchors}
  UNION ALL
  SELECT /*+ MERGE(n) */ c.id, n.parent, n.slot, coalesce(c.subroot, n.subroot),
    transform(c.folded, x -> unhex(sha2(concat(
      lower(hex(substr(n.children, 1, 32 * c.slot))), lower(hex(x)), lower(hex(substr(n.children, 32 * c.slot + 33)))), 256))),
    concat(c.path, substr(n.children, 1, 32 * c.slot), substr(n.children, 32 * c.slot + 33))
  FROM climb c JOIN {nodes} n ON n.id = c.parent
)
SELECT id, subroot, folded, path FROM climb WHERE parent IS NULL
"""


def proofs(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    ``folded_root`` is what the claimed leaf and the stored siblings lead to.
    """
    spark = manifest.runs.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # every row climbs, however many there are

    def with_claim(x):
        run = F.transform("leaves", lambda y: F.when(y["slot"] == x["slot"], spelled(x["claim"])).otherwise(spelled(y["leaf"])))
        return F.when(F.col("lone"), x["claim"]).otherwise(digest(F.array_join(run, "")))

    anchors = manifest.runs.select(
        "id", "parent", "slot", "subroot", F.transform("leaves", with_claim).alias("folded"), F.lit(b"").alias("path")
    )
    climbed = spark.sql(CLIMB, anchors=anchors, nodes=manifest.nodes.select("id", "parent", "slot", "subroot", "children"))

    def siblings(x):
        return F.array_join(F.transform(F.filter("leaves", lambda y: y["slot"] != x["slot"]), lambda y: spelled(y["leaf"])), "")

    told = F.transform("leaves", lambda x, at: F.struct(
        x["id"].alias("id"), spelled(x["leaf"]).alias("leaf"),
        F.sha2(F.concat(siblings(x), spelled(F.col("path"))), 256).alias("proof_sha256"),
        spelled(F.get("folded", at)).alias("folded_root"),
    ))
    root = F.lit(manifest.root)
    met = climbed.join(manifest.runs.select("id", "leaves").hint("merge"), "id")
    return met.select(F.explode(told).alias("x"), spelled(F.col("subroot")).alias("subroot")).select(
        "x.id", "x.leaf", "subroot", root.alias("root"), "x.proof_sha256", "x.folded_root",
        (F.col("x.folded_root") == root).alias("verified"),
    )


def _no_runs(leaves: DataFrame, fan: int) -> DataFrame:
    member = F.array(F.struct(F.lit(0).alias("slot"), "id", "leaf", "claim"))
    return leaves.limit(0).select(
        F.lit("").alias("id"), F.lit("").alias("parent"), F.lit(0).alias("slot"), F.col("leaf").alias("subroot"),
        member.alias("leaves"), F.lit(True).alias("lone"),
    )


def _no_nodes(leaves: DataFrame) -> DataFrame:
    return leaves.limit(0).select(
        F.lit("").alias("id"), F.lit("").alias("parent"), F.lit(0).alias("slot"),
        F.col("leaf").alias("subroot"), F.col("leaf").alias("children"),
    )
