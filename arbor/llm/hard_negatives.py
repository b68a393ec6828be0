"""Hard negatives by exact integer inner products in float32 matrix products.

Vectors become whole numbers, floor(scale * x). Their inner products are
computed modulo several small primes: each residue matrix holds centred
residues, so a float32 product over at most ``2^24 / half^2`` components is exact,
and balanced mixed-radix digits (Chinese remaindering) give the signed score.
As many primes are taken as the largest possible score needs: by
Cauchy-Schwarz the largest sum of squares of a row.

The anchors are a stated query set against all rows. They go in groups of at
most ``GROUP`` components (one anchor at least), ordered by id; a group's matrix
is broadcast (32 MB at most), every task multiplies its rows with it in
tiles and keeps the best few for each anchor, and windows in Spark pick the
first ones over all tasks. One pass finds the positives, a second one, with each
positive's window of scores, the negatives. Nothing is shuffled by label, so a hot
label is no hot key, and a tile of equal vectors is no more than a tile.

Defined cases: rows with a null id, label or vector, with a null or non-finite
component, or whose sum of squares reaches 2^62 (a score would not fit in a
long) take no part; vectors are compared with those of as many components; an
empty vector scores 0; repeated rows are rows of their own (an anchor's copy is
another row); ties go to the smaller id; an anchor without positives, or a
positive without rows in its window, gives no rows; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbor.llm.common import load, ship_code, stage_table
from arbor.llm.ranks import partitions

#: Primes under 512, from the largest: 9 bits each, and products of up to 260
#: centred residues stay under 2^24.
PRIMES = [p for p in range(511, 200, -2) if all(p % d for d in range(3, 23, 2))]
#: Components of the anchors in a group, and at most so many anchors.
GROUP, MOST_ANCHORS = 1 << 22, 1 << 15
#: Anchors and rows in a tile.
TILE_A, TILE_B = 512, 2048
#: A table of fewer rows than this for each shuffle partition is dealt out anew,
#: as its files would make too few tasks for the work on them.
TASK_ROWS = 16_384
NONE = np.iinfo(np.int64).min


# ------------------------------------------------------ exact matrix product
def primes_for(bound: int) -> list[int]:
    """The fewest primes (two at least) whose product exceeds twice the bound."""
    product, out = 1, []
    for p in PRIMES:
        if len(out) >= 2 and product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of whole numbers as float32, one matrix a prime."""
    return [((x + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def product(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact int64 matrix a @ b.T from the residues of a and b."""
    digits: list[np.ndarray] = []
    for x, y, p in zip(a, b, primes):
        step = (1 << 24) // (p // 2) ** 2
        rest = np.zeros((x.shape[0], y.shape[0]), np.int64)
        for k in range(0, max(x.shape[1], 1), step):
            rest += (x[:, k:k + step] @ y[:, k:k + step].T).astype(np.int64) % p
        for q, digit in zip(primes, digits):  # what is left after the digits so far, modulo p
            rest = (rest - digit) * pow(q, -1, p) % p
        rest %= p
        digits.append(np.where(rest > p // 2, rest - p, rest))
    out, weight = np.zeros_like(digits[0]), 1
    for p, digit in zip(primes, digits):
        out += digit * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))  # the sum fits, so wrapping is exact
        weight *= p
    return out


# ------------------------------------------------------------- the best few
def best(score: np.ndarray, keep: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``k`` kept columns of each row: higher scores
    first, ties by smaller id."""
    held = np.where(keep, score, NONE)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        keep = keep & (held >= least[:, None])
    row, col = np.nonzero(keep)
    return _first(row, score[row, col], ids[col], k, row, col)


def _first(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, *columns: np.ndarray):
    """``columns`` of the first ``k`` of each key."""
    order = np.lexsort((ids, ~score, key))
    sorted_key = key[order]
    start = np.searchsorted(sorted_key, sorted_key)
    order = order[np.arange(order.size) - start < k]
    return tuple(c[order] for c in columns)


class _Top:
    """The first ``k`` of each slot seen so far; slots are whole numbers."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.after = k, [], 0, 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if slot.size:
            self.parts.append((slot, score, ids))
            self.size += slot.size
            if self.size > 2 * self.after + 200_000:
                self.parts = [self.held()]
                self.size = self.after = self.parts[0][0].size

    def held(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.empty(0, np.int64),) * 3
        slot, score, ids = (np.concatenate(c) for c in zip(*self.parts))
        return _first(slot, score, ids, self.k, slot, score, ids)


def _search(anchors: dict, primes: list[int], slots: int, k: int, select):
    """Function for mapInArrow over the rows: (slot, score, id) of the best
    ``k`` of each slot, an anchor's number times ``slots`` and more.
    ``select``: (anchors of the tile, rows of the tile, scores) -> the kept
    pairs of each of an anchor's slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = anchors.value
        ready = {d: residues(t["x"], primes) for d, t in tables.items()}
        top = _Top(k)
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "id", "label", "dims")}
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(cols["dims"])
            for d, table in tables.items():
                at = np.flatnonzero(cols["dims"] == d)
                for lo in range(0, at.size, TILE_B):
                    part = at[lo:lo + TILE_B]
                    x = flat[(ends[part] - d)[:, None] + np.arange(d)]
                    rows = {c: v[part] for c, v in cols.items()}
                    right = residues(x, primes)
                    for a in range(0, len(table["rid"]), TILE_A):
                        tile = {c: v[a:a + TILE_A] for c, v in table.items()}
                        score = product([r[a:a + TILE_A] for r in ready[d]], right, primes)
                        for j, keep in enumerate(select(tile, rows, score)):
                            r, c = best(score, keep, rows["id"], k)
                            top.add(tile["number"][r] * slots + j, score[r, c], rows["id"][c])
        slot, score, ids = top.held()
        for lo in range(0, slot.size, 100_000):
            cut = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot[cut], pa.int64()),
                                              "score": pa.array(score[cut], pa.int64()),
                                              "id": pa.array(ids[cut], pa.int64())})

    return run


SCHEMA = "slot long, score long, id long"


# ------------------------------------------------------------------ the job
def whole_vectors(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(rid, id, label, dims, x, squares): rows that take part, as whole numbers."""
    x = F.transform(F.col("v"), lambda c: F.floor(c.cast("double") * scale).cast("long"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) < float("inf")))
    out = (rows.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("id"),
                       F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
           .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & usable)
           .select("rid", "id", "label", F.size("v").cast("long").alias("dims"), x.alias("x")))
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return out.withColumn("squares", squares).where(F.col("squares") < float(1 << 62))


def _tables(rows: list) -> dict:
    """Anchors as matrices, one for each number of components."""
    out: dict = {}
    for r in rows:
        out.setdefault(r["dims"], []).append(r)
    return {d: {c: np.array([r[c] for r in got], np.int64).reshape((len(got), d) if c == "x" else (len(got), -1)[:1])
                for c in ("rid", "number", "label", "x")} for d, got in out.items()}


def mine(rows: DataFrame, anchor, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
         scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         group: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each row that ``anchor`` (a condition on the id column
    ``id``) picks, and each of its ``positives`` best other rows of its label, the
    best ``negatives`` rows of other labels scored from ``low`` to ``high``
    percent of the positive's score."""
    spark = rows.sparkSession
    ship_code(spark)
    table = stage_table(whole_vectors(rows, vec_id, vector, label, scale), "mine-rows")
    picked = table.where(anchor)
    size = table.agg(F.max("squares").alias("most"), F.max("dims").alias("dims"), F.count(F.lit(1)).alias("n")).first()
    n, primes = picked.count(), primes_for(int(size["most"] or 0) + 1)
    group = group or min(MOST_ANCHORS, max(1, GROUP // max(size["dims"] or 1, 1)))
    data, tasks = table.select("rid", "id", "label", "dims", "x"), partitions(spark)
    if size["n"] <= tasks * TASK_ROWS:
        data = data.repartition(tasks, "rid")
    # groups of bounded size by ranges of (id, rid): cuts are exact, as rid is unique
    order, cuts = ["id", "rid"], [None]
    while n > group * len(cuts):
        after = cuts[-1]
        left = picked if after is None else picked.where(_beyond(after))
        last = left.orderBy(*order).limit(group).agg(F.max(F.struct("id", "rid")).alias("last")).first()["last"]
        cuts.append((last["id"], last["rid"]))
    found = None
    for k, after in enumerate(cuts):
        own = picked if after is None else picked.where(_beyond(after))
        if k + 1 < len(cuts):
            own = own.where(~_beyond(cuts[k + 1]))
        anchors = [dict(r.asDict(), number=j) for j, r in enumerate(
            own.select("rid", "id", "label", "dims", "x").orderBy(*order).collect())]  # at most ``group`` rows
        if not anchors:
            continue
        part = stage_table(_mine_group(spark, data, anchors, primes, positives, negatives, low, high), "mine-group")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    return found


def _beyond(cut: tuple[int, int]):
    return (F.col("id") > cut[0]) | ((F.col("id") == cut[0]) & (F.col("rid") > cut[1]))


def _mine_group(spark, data: DataFrame, anchors: list, primes: list[int], positives: int, negatives: int,
                low: int, high: int) -> DataFrame:
    tables = _tables(anchors)
    shared = spark.sparkContext.broadcast(tables)

    def same(a, b, score):
        yield (a["label"][:, None] == b["label"]) & (a["rid"][:, None] != b["rid"])

    def first(found: DataFrame, k: int) -> DataFrame:
        by = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    pos = first(data.mapInArrow(_search(shared, primes, 1, positives, same), SCHEMA), positives)
    pos = stage_table(pos.select("slot", "rank", "score", "id"), "mine-positives")

    # the windows of whole scores: low <= 100 * score / positive <= high
    edges = {c: np.full((len(anchors), positives), v, np.int64) for c, v in (("lo", 1), ("hi", 0))}
    for r in pos.collect():  # at most ``group`` times ``positives`` rows of four numbers
        edges["lo"][r["slot"], r["rank"] - 1] = -(-low * r["score"] // 100)
        edges["hi"][r["slot"], r["rank"] - 1] = high * r["score"] // 100
    bounded = spark.sparkContext.broadcast(
        {d: t | {c: v[t["number"]] for c, v in edges.items()} for d, t in tables.items()})

    def window(a, b, score):
        other = a["label"][:, None] != b["label"]
        for j in range(positives):
            yield other & (score >= a["lo"][:, j, None]) & (score <= a["hi"][:, j, None])

    neg = first(data.mapInArrow(_search(bounded, primes, positives, negatives, window), SCHEMA), negatives)
    ids = spark.createDataFrame([(a["number"], a["id"]) for a in anchors], "number long, anchor_id long")
    pos = pos.select((F.col("slot") * positives + F.col("rank") - 1).alias("slot"), F.col("slot").alias("number"),
                     F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = neg.select("slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (neg.join(pos, "slot").join(F.broadcast(ids), "number")  # at most ``group`` rows
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", turned.alias("label")), F.col("id") % 50 == 0)
