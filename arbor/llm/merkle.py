"""Merkle manifest of a dataset: leaves, subroots by group, root, proofs.

A leaf is the digest of a row's named columns. In each group (source) the
leaves ascend by id, and every ``ARITY`` consecutive nodes become the digest of
their digests (as lowercase hex text) until one node is left, the group's
subroot; the subroots, in order of their group, give the root the same way.

Every level is one self-join: a node is offered to the computed indices of its
run's other slots (slot plus 1 .. ``ARITY`` - 1, modulo ``ARITY``; for pairs that
is the exclusive or with 1), an equijoin on (tree, index) finds the nodes that
are there, and an aggregation on the join's own key gathers at most
``ARITY`` - 1 siblings. Slot-zero rows, with their siblings, emit the parents.
Proofs go the other way: a parent hands its path to the children of its run, one
join for each level. Keys are (tree, index), so a hot group spreads over all
tasks, and digests travel as 32 bytes. The number of levels is known
from the group sizes before the first join.

Defined cases: a null column value is ``-`` in the leaf, so it differs from an
empty text; a null group is a group of its own and the first; null ids come
first in their group; rows under one id are ordered by their leaf, and fully
equal rows are nodes of their own with equal leaves; a lone leaf is its
subroot, a lone subroot the root, and a proof without siblings is the digest of
the empty string; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import join_bounded, load, stage_table
from arbor.llm.ranks import place_in

#: Nodes in a run, and the columns of a leaf in order.
ARITY = 16
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def digest(data: Column) -> Column:
    """sha256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def field(value: Column) -> Column:
    """A value with its UTF-8 length in front; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def text_of(h: Column | str) -> Column:
    """Digests one after the other as lowercase hex text."""
    return F.lower(F.hex(h))


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit("").cast("binary"), lambda all, x: F.concat(all, x))


def heights(nodes: DataFrame) -> int:
    """Levels above the leaves of the largest tree."""
    left, levels = nodes.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0], 0
    while left > 1:
        left, levels = -(-left // ARITY), levels + 1
    return levels


def siblings(nodes: DataFrame) -> DataFrame:
    """(tree, at, n, h and more) -> the same with ``slot``, ``before`` and
    ``after``: the digests of the run's other nodes left and right of each, in
    order, 32 bytes a node."""
    slot, kept = F.col("at") % ARITY, [c for c in nodes.columns if c not in ("tree", "at")]
    offers = nodes.select("tree", F.col("at").alias("other"), F.col("h").alias("other_h"),
                          F.explode(F.sequence(F.lit(1), F.lit(ARITY - 1))).alias("shift"))
    own = F.col("other") % ARITY
    offers = offers.select("tree", "other", "other_h",
                           (F.col("other") - own + (own + F.col("shift")) % ARITY).alias("at"))
    near = nodes.join(offers, ["tree", "at"], "left")
    met = F.when(F.col("other").isNotNull(), F.struct("other", "other_h"))
    run = near.groupBy("tree", "at").agg(*[F.first(c).alias(c) for c in kept],
                                         F.sort_array(F.collect_list(met)).alias("run"))

    def side(keep) -> Column:
        return _joined(F.transform(F.filter("run", keep), lambda x: x["other_h"]))

    return run.select("tree", "at", *kept, slot.alias("slot"),
                      side(lambda x: x["other"] < F.col("at")).alias("before"),
                      side(lambda x: x["other"] > F.col("at")).alias("after"))


def grow(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(tree, at, n, h and more) -> the levels with their siblings, without the
    last node of each tree, and (tree, root)."""
    levels, roots, nodes = [], leaves.where(F.col("n") == 1), leaves.where(F.col("n") > 1)
    roots = roots.select("tree", F.col("h").alias("root"))
    for k in range(heights(leaves)):
        level = stage_table(siblings(nodes), f"{name}-level-{k}")
        levels.append(level)
        up = level.where(F.col("slot") == 0).select(
            "tree", F.floor(F.col("at") / ARITY).cast("long").alias("at"),
            F.floor((F.col("n") + (ARITY - 1)) / ARITY).cast("long").alias("n"),
            digest(text_of(F.concat("h", "after"))).alias("h"))
        roots = roots.unionByName(up.where(F.col("n") == 1).select("tree", F.col("h").alias("root")))
        nodes = up.where(F.col("n") > 1)
    return levels, stage_table(roots, f"{name}-roots")


def paths(levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The lowest level's nodes with ``path``, the (before, after) of each level
    up to the tree's last node and then those of ``tops`` (tree, rest), and the
    columns that ``tops`` hands down. A path crosses the network once for
    each run of children."""
    handed = [c for c in tops.columns if c not in ("tree", "rest")]
    own, above = F.array(F.struct("before", "after")), None
    for k, level in reversed(list(enumerate(levels))):
        kept = [c for c in level.columns if c not in ("n", "slot", "before", "after")]
        last = join_bounded(level.where(F.col("n") <= ARITY), tops, ["tree"])
        found = last.select(*kept, *handed, F.concat(own, "rest").alias("path"))
        if above is not None:
            parents = above.select("tree", F.col("at").alias("parent"), *handed, F.col("path").alias("rest"))
            lower = level.where(F.col("n") > ARITY).withColumn("parent", F.floor(F.col("at") / ARITY).cast("long"))
            lower = lower.join(parents, ["tree", "parent"])
            found = found.unionByName(lower.select(*kept, *handed, F.concat(own, "rest").alias("path")))
        above = found if k == 0 else stage_table(found, f"{name}-paths-{k}")
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and its path give."""
    return F.aggregate(path, start, lambda h, x: digest(text_of(F.concat(x["before"], h, x["after"]))))


def manifest(rows: DataFrame, *, doc_id: str = "doc_id", group: str = "source", columns: Sequence[str] = LEAF,
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256 and
    ``folded_root``, the root that the row's leaf gives with its siblings.
    ``tampered``: other values of some columns, which go in the leaf that is
    folded and in nothing else."""
    changed = tampered or {}
    facts = stage_table(rows.select(
        F.monotonically_increasing_id().alias("rid"),  # tells apart equal rows
        F.col(doc_id).alias("i"), F.col(group).cast("string").alias("tree_name"),
        leaf([F.col(c) for c in columns]).alias("h"),
        leaf([changed.get(c, F.col(c)) for c in columns]).alias("seen")), "merkle-leaves")
    names = stage_table(facts.select("tree_name").distinct().withColumn("all", F.lit(0)), "merkle-groups")
    names = stage_table(place_in(names, "all", ["tree_name"], "merkle-groups"), "merkle-trees")
    trees = names.select(F.col("tree_name"), F.col("at").alias("tree"))
    placed = place_in(facts, "tree_name", ["i", "h", "rid"], "merkle")
    small = F.broadcast(trees) if trees.count() <= 100_000 else trees
    placed = stage_table(
        placed.join(small.withColumnRenamed("tree_name", "own"), F.col("tree_name").eqNullSafe(F.col("own")))
        .select("i", "h", "seen", "tree", "at", "n"), "merkle-places")

    levels, subroots = grow(placed, "merkle")
    crowns = stage_table(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"),
                        F.lit(subroots.count()).cast("long").alias("n"), F.col("root").alias("h")), "merkle-crowns")
    upper, root = grow(crowns, "merkle-crown")
    empty = F.array().cast("array<struct<before:binary,after:binary>>")
    top = root.select("tree", "root", empty.alias("rest"))
    if upper:
        tops = paths(upper, top, "merkle-crown").select(
            F.col("at").alias("tree"), F.col("h").alias("subroot"), "root", F.col("path").alias("rest"))
    else:
        tops = crowns.join(top, "tree").select(F.col("at").alias("tree"), F.col("h").alias("subroot"), "root", "rest")
    tops = stage_table(tops, "merkle-tops")

    alone = join_bounded(placed.where(F.col("n") == 1), tops, ["tree"])
    out = alone.select("i", "h", "seen", "subroot", "root", F.col("rest").alias("path"))
    if levels:
        out = out.unionByName(paths(levels, tops, "merkle").select("i", "h", "seen", "subroot", "root", "path"))
    proof = _joined(F.transform("path", lambda x: F.concat(x["before"], x["after"])))
    return out.select(
        F.col("i").alias(doc_id), text_of("h").alias("leaf"), text_of("subroot").alias("subroot"),
        text_of("root").alias("root"), F.sha2(text_of(proof), 256).alias("proof_sha256"),
        text_of(fold(F.col("seen"), F.col("path"))).alias("folded_root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Where 5 divides the id's crc32, the text folded has its A-Z lowered."""
    docs = load(spark, sf_dir, "documents").select(*LEAF)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest(docs, tampered={"text": F.when(hit, lowered).otherwise(F.col("text"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
