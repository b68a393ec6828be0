"""Exact dedup by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of ``BLOCK`` code points. Distinct blocks
are sorted and get integer names; then neighbouring pairs of names are sorted
and named again, until each document has one name. Two documents of as many
blocks have the same last name exactly if all their blocks are equal, so the
identity has no collisions.

The blocks travel as 64-bit fingerprints. Before the names count, an
aggregation over the block texts proves that no fingerprint stands for two
texts; if one ever does, the blocks themselves are named instead. So long
texts cross the network once, combined on the map side, and a hot block is
one row of the naming, whatever its copies; joins back to the copies are
split by AQE.

Defined cases: a null text counts as empty, and all empty texts are equal; of
equal texts the longest original stays, then the smallest id (null ids come
last), then one of the repeated rows; extra columns are kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.llm.common import fresh, load, null_safe, stage_table

#: Code points in a block.
BLOCK = 2048
#: Names sorted in one window partition.
BUCKET_ROWS = 4096


def normalise(text: Column) -> Column:
    """The text without its ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for space in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(space))
    return out


def blocks(norm: Column, size: int = BLOCK) -> Column:
    """Fixed-size blocks in order; an empty text is one empty block."""
    cut = F.regexp_extract_all(norm, F.lit("(?s).{1,%d}" % size), F.lit(0))
    return F.when(F.octet_length(norm) <= size, F.array(norm)).otherwise(cut)


def assign_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with an integer ``name``, equal exactly where ``keys`` are.

    The distinct keys are dealt to buckets, sorted in each, and named by
    bucket and place; names depend on the set of keys alone."""
    distinct = stage_table(rows.select(*keys).distinct(), "dedup-keys")
    buckets = max(1, -(-distinct.count() // BUCKET_ROWS))
    sort = Window.partitionBy("bucket").orderBy(*keys)
    named = (distinct.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
             .withColumn("name", (F.row_number().over(sort) - 1).cast("long") * buckets + F.col("bucket"))
             .select(*keys, "name"))
    return rows.join(named, keys)


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, size: int = BLOCK,
               fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: i, n_chars, sha, rid, n_blocks, name."""
    norm = (docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
            .select("i", F.coalesce(F.length("t"), F.lit(0)).cast("long").alias("n_chars"),
                    normalise(F.col("t")).alias("norm")))
    facts = stage_table(
        norm.select(F.monotonically_increasing_id().alias("rid"), "i", "n_chars",
                    F.sha2("norm", 256).alias("sha"),
                    F.transform(blocks(F.col("norm"), size), lambda b: fingerprint(b)).alias("keys")), "dedup-facts")
    doubles = (norm.select(F.explode(blocks(F.col("norm"), size)).alias("block"))
               .groupBy(fingerprint(F.col("block")).alias("key"))
               .agg(F.min("block").alias("a"), F.max("block").alias("b")).where(F.col("a") != F.col("b")))
    if doubles.limit(1).count():
        facts = stage_table(
            norm.select(F.monotonically_increasing_id().alias("rid"), "i", "n_chars",
                        F.sha2("norm", 256).alias("sha"), blocks(F.col("norm"), size).alias("keys")),
            "dedup-texts")
    rows = facts.select("rid", F.size("keys").alias("n_blocks"), F.size("keys").alias("m"),
                        F.posexplode("keys").alias("at", "key"))
    rows = stage_table(assign_names(rows, ["key"]).drop("key"), "dedup-level-0")
    done = rows.where(F.col("m") == 1).select("rid", "n_blocks", "name")
    rows, level = rows.where(F.col("m") > 1), 0
    while rows.limit(1).count():
        level += 1
        pairs = (rows.groupBy("rid", "n_blocks", "m", F.shiftright("at", 1).alias("half"))
                 .agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("one"),
                      F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("two")))
        pairs = pairs.select("rid", "n_blocks", F.floor((F.col("m") + 1) / 2).cast("int").alias("m"),
                             F.col("half").alias("at"), "one", "two")
        rows = stage_table(assign_names(pairs, ["one", "two"]).drop("one", "two"), f"dedup-level-{level}")
        done = done.unionByName(rows.where(F.col("m") == 1).select("rid", "n_blocks", "name"))
        rows = rows.where(F.col("m") > 1)
    return facts.drop("keys").join(done, "rid")


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chars."""
    rows = stage_table(identities(docs, doc_id, text, **options), "dedup-identities")
    first = F.struct((-F.col("n_chars")).alias("len"), F.col("i").isNull().alias("none"), "i", "rid")
    best = rows.groupBy("n_blocks", "name").agg(F.min(first).alias("keep"),
                                                F.count(F.lit(1)).alias("group_size"))
    return (rows.join(best, ["n_blocks", "name"])
            .select(F.col("i").alias(doc_id), F.col("keep.i").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("keep.rid")).alias("kept"), F.col("sha").alias("text_sha256"),
                    "n_chars"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns: one of each group."""
    i, sha, chars, many = fresh(docs, "id", "sha", "chars", "many")
    marks = groups(docs, doc_id=doc_id, text=text, **options)
    keys = marks.groupBy(F.col(doc_id).alias(i), F.col("text_sha256").alias(sha),
                         F.col("n_chars").alias(chars))
    keys = (keys.agg(F.max("kept").alias("stay"), (F.count(F.lit(1)) > 1).alias(many))
            .where("stay").drop("stay"))
    own, length = fresh(docs, "own_sha", "own_chars")
    rows = (docs.withColumn(own, F.sha2(normalise(docs[text]), 256))
            .withColumn(length, F.coalesce(F.length(docs[text]), F.lit(0)).cast("long")))
    rows = rows.join(keys, null_safe(rows, keys, [(doc_id, i)]) & (rows[own] == keys[sha])
                     & (rows[length] == keys[chars]))
    single = rows.where(~F.col(many)).select(*docs.columns)
    again = rows.where(F.col(many))
    if not again.limit(1).count():
        return single
    # rows that share id, digest and length: the least of their other columns, then of the text
    row, = fresh(docs, "row")
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text]))
    one = again.groupBy(i, sha, chars).agg(F.min_by(F.struct(*docs.columns), F.struct(others, F.col(text))).alias(row))
    return single.unionByName(one.select(f"{row}.*"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = groups(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
