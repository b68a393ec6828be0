"""Approximate nearest neighbours by shifted space-filling curves.

Nearness is the largest inner product. Rows are put on the unit sphere with one
more component (``sqrt(1 - |v|^2 / M^2)``, M the largest norm), where a row near a
normalised query has a large inner product with it. Each of ``CURVES`` orderings
projects these vectors by a random orthogonal matrix to ``AXES`` dimensions,
scales and shifts them at random, and takes the place on a Hilbert curve as a
key. The keys of all orderings are range-partitioned and sorted by Spark, which
gives every row its position on every curve. A query meets the blocks of
``BLOCK`` neighbouring rows that its window touches on each curve: ``SHARE`` of
all rows and ``LEAST`` more on either side. The windows' best rows are merged and ranked
by exact inner products (components added in order, in double precision).

Vectors in many dimensions without structure have no near neighbours that a
curve keeps close, so the window is a share of all rows, not a number, and recall
is the same at every size; the work is that share of queries times rows.
Equal vectors are one class on the curves and bring their smallest ids at the
end, so a vector that a third of the rows share is one entry, and ties among its copies
are exact. Blocks are cut by position, and a block that many queries meet is
dealt to several tasks.

Projections are scaled on a sample of at most ``FIT`` rows (the smallest hashes).

Defined cases: rows with a null id or a null, empty or zero vector, or with a null
or non-finite component, take no part; vectors are compared with those of
as many components; repeated rows are rows of their own, and a query's own row
alone is left out; ties go to the smaller id; with fewer candidates than
``k`` all that were met are returned; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.llm.common import load, ship_code, stage_table
from arbor.llm.ranks import partitions

#: Orderings, dimensions of each, and rows of the sample that scales them.
CURVES, AXES, FIT = 16, 12, 4096
#: A window's rows on either side: a share of all rows, and so many more.
SHARE, LEAST = 0.035, 32
#: Rows in a block, and queries that one task searches in it.
BLOCK, QUERIES = 4096, 4096
SEED = 20


# ------------------------------------------------------------------- curves
def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the cells, a row of whole numbers under
    2^bits each (Skilling's transform of the axes, then interleaved bits)."""
    x = [c.astype(np.int64) for c in cells.T]
    for b in range(bits - 1, 0, -1):
        top, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            flip = (x[i] & top) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> b) & 1, turn ^ ((1 << b) - 1), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> b) & 1)
    return key


class Curve:
    """Ordering ``t`` of vectors of ``dims`` components."""

    def __init__(self, t: int, dims: int, sample: np.ndarray):
        rng = np.random.default_rng([SEED, dims, t])
        axes = min(AXES, dims)
        self.bits = min(10, 60 // axes)
        self.turn = np.linalg.qr(rng.standard_normal((dims, axes)))[0]
        self.shift = rng.uniform(0, 1, axes)
        self.middle = sample.mean(0) if len(sample) else np.zeros(dims)
        spread = ((sample - self.middle) @ self.turn).std(0) if len(sample) > 1 else np.zeros(axes)
        self.spread = np.where(spread > 1e-9, spread, 1 / np.sqrt(dims))

    def keys(self, x: np.ndarray) -> np.ndarray:
        # four deviations to either side fill half of the cube, the shift moves them in the other half
        at = ((x - self.middle) @ self.turn / self.spread + 4) / 16 + self.shift / 2
        return hilbert(np.floor(np.clip(at, 0, 1 - 1e-9) * (1 << self.bits)), self.bits)


def on_sphere(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    if query:
        return np.hstack([x / norm, np.zeros_like(norm)])
    return np.hstack([x / largest, np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))])


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, rows, matrix) for each number of components in a list column."""
    dims = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(dims) - dims
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield int(d), rows, flat[start[rows][:, None] + np.arange(d)].astype(np.float64)


def curve_entries(classes: DataFrame, largest: float, fit: dict) -> DataFrame:
    """(curve, key, c, asks): each class on each curve, and once more, as a
    query, if it asks."""
    shared = classes.sparkSession.sparkContext.broadcast(fit)  # at most FIT vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves: dict[int, list[Curve]] = {}
        for batch in batches:
            c = batch.column("c").to_numpy(zero_copy_only=False)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            for d, rows, x in _matrices(batch.column("v")):
                if d not in curves:
                    sample = shared.value.get(d, np.empty((0, d)))
                    sample = on_sphere(sample, largest, False) if len(sample) else np.empty((0, d + 1))
                    curves[d] = [Curve(t, d + 1, sample) for t in range(CURVES)]
                for query, part in ((False, slice(None)), (True, asks[rows])):
                    points = on_sphere(x[part], largest, query)
                    if not len(points):
                        continue
                    for t, curve in enumerate(curves[d]):
                        n = len(points)
                        yield pa.RecordBatch.from_pydict({
                            "curve": pa.array(np.full(n, d * CURVES + t), pa.int64()),
                            "key": pa.array(curve.keys(points), pa.int64()),
                            "c": pa.array(c[rows][part], pa.int64()), "asks": pa.array(np.full(n, query))})

    return classes.select("c", "asks", "v").mapInArrow(run, "curve long, key long, c long, asks boolean")


def positions(entries: DataFrame) -> DataFrame:
    """(curve, c, asks, at, n): how many rows stand before an entry on its
    curve, and how many there are. Keys that are equal stand in order of a hash."""
    tie = F.xxhash64("c", "asks")
    put = (entries.repartitionByRange(partitions(entries.sparkSession), "curve", "key", tie)
           .sortWithinPartitions("curve", "key", tie).select("curve", "c", "asks", F.spark_partition_id().alias("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, 0
        for batch in batches:
            curve = batch.column("curve").to_numpy(zero_copy_only=False)
            row = ~batch.column("asks").to_numpy(zero_copy_only=False)
            before = np.cumsum(row) - row
            starts = np.flatnonzero(np.diff(curve, prepend=-1))
            if curve.size and curve[0] == last:
                before[:starts[1] if starts.size > 1 else None] += rows
            for lo in starts[1:]:
                stop = starts[starts > lo]
                cut = slice(lo, stop[0] if stop.size else None)
                before[cut] -= before[lo]
            if curve.size:
                last, rows = curve[-1], int(before[-1] + row[-1])
            yield pa.RecordBatch.from_pydict({
                "curve": batch.column("curve"), "c": batch.column("c"), "asks": batch.column("asks"),
                "part": batch.column("part"), "before": pa.array(before, pa.int64())})

    put = stage_table(put.mapInArrow(run, "curve long, c long, asks boolean, part int, before long"), "curve-sorted")
    runs = put.groupBy("curve", "part").agg(F.sum(F.when(~F.col("asks"), 1).otherwise(0)).alias("rows"))
    runs = runs.select("curve", "part",
                       (F.sum("rows").over(Window.partitionBy("curve").orderBy("part")) - F.col("rows")).alias("first"),
                       F.sum("rows").over(Window.partitionBy("curve")).alias("n"))
    runs = stage_table(runs, "curve-offsets")
    runs = F.broadcast(runs) if runs.count() <= 100_000 else runs
    return put.join(runs, ["curve", "part"]).select("curve", "c", "asks", (F.col("before") + F.col("first")).alias("at"), "n")


# ------------------------------------------------------------------- search
def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, components added in order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out = out + a[:, j] * b[:, j]
    return out


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, tile: int = 256) -> tuple[np.ndarray, ...]:
    """(query, row, score) of each query's ``k`` best rows: larger exact scores
    first, ties by smaller id. A matrix product finds them, with some slack for its rounding."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    norm = np.sqrt((x * x).sum(1)).max(initial=0)
    for lo in range(0, len(q), tile):
        rough = q[lo:lo + tile] @ x.T
        slack = 1e-12 * norm * np.sqrt((q[lo:lo + tile] ** 2).sum(1))
        if rough.shape[1] > k:
            least = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
            row, col = np.nonzero(rough >= (least - slack)[:, None])
        else:
            row, col = np.nonzero(np.ones_like(rough, bool))
        score = inner(q[lo + row], x[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(row.size) - np.searchsorted(row, row) < k
        out.append((lo + row[keep], col[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def window_search(places: DataFrame, classes: DataFrame, k: int, share: float, least: int) -> DataFrame:
    """(q, c, id, score): the best classes of each asking class in each block
    that its windows touch."""
    half = F.ceil(F.col("n") * share) + least
    asks = places.where("asks").select(
        "curve", F.col("c").alias("q"),
        F.explode(F.sequence(F.floor(F.greatest(F.col("at") - half, F.lit(0)) / BLOCK),
                             F.floor(F.least(F.col("at") + half, F.col("n") - 1) / BLOCK))).alias("block"))
    asks = stage_table(asks.withColumn("block", F.col("block").cast("long")), "curve-asks")
    load_of = asks.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("tasks"))
    load_of = stage_table(load_of, "curve-load")
    # blocks that many queries meet are searched by several tasks
    asks = (asks.join(load_of, ["curve", "block"])
            .select("curve", "block", F.pmod(F.xxhash64("q"), F.col("tasks")).cast("int").alias("task"), "q")
            .join(classes.select(F.col("c").alias("q"), F.col("v").alias("qv")), "q"))
    rows = (places.where(~F.col("asks"))
            .select("curve", "c", F.floor(F.col("at") / BLOCK).cast("long").alias("block"))
            .join(load_of, ["curve", "block"])
            .select("curve", "block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "c")
            .join(classes.select("c", F.col("ids")[0]["id"].alias("id"), F.col("v").alias("v")), "c"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (_, _, q), = _matrices(left.column("qv").combine_chunks())  # a curve has one number of components
        (_, _, x), = _matrices(right.column("v").combine_chunks())
        name, c, ids = (t.column(n).to_numpy() for t, n in ((left, "q"), (right, "c"), (right, "id")))
        row, col, score = nearest(q, x, ids, k)
        return pa.table({"q": name[row], "c": c[col], "id": ids[col], "score": score}, schema=schema)

    keys = ["curve", "block", "task"]
    return (asks.select(*keys, "q", "qv").groupBy(*keys).cogroup(rows.select(*keys, "c", "id", "v").groupBy(*keys))
            .applyInArrow(search, "q long, c long, id long, score double"))


# ------------------------------------------------------------------ the job
def usable(v: Column) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    return (v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """(rid, id, asks, v) -> (c, ids, asks, v): a row for each distinct vector
    with its ``k`` smallest (id, rid)."""
    heads = rows.groupBy("v").agg(F.min("rid").alias("c"), F.max("asks").alias("asks"))
    by = Window.partitionBy("v").orderBy("id", "rid")  # limited to k rows of a vector before the shuffle
    firsts = (rows.select("v", "id", "rid").withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
              .groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "rid"))).alias("ids")))
    return heads.join(firsts, "v").select("c", "ids", "asks", "v")


def neighbours(rows: DataFrame, asks: Column, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
               share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each
    row that ``asks`` (a condition on the id column ``id``) picks."""
    spark = rows.sparkSession
    ship_code(spark)
    table = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("id"),
                        F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    table = stage_table(table.withColumn("asks", F.coalesce(asks, F.lit(False))), "curve-rows")
    classes = stage_table(vector_classes(table, k + 1), "curve-classes")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = classes.agg(F.max(square).alias("square"), F.max(F.size("v")).alias("dims")).first()
    if size["square"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = float(np.sqrt(size["square"])) or 1.0
    some = classes.orderBy(F.xxhash64("c"), "c").limit(max(1, min(FIT, (1 << 21) // size["dims"])))
    fit: dict = {}
    for r in some.select("v").collect():  # at most FIT rows and 2^21 numbers
        fit.setdefault(len(r["v"]), []).append(r["v"])
    entries = stage_table(curve_entries(classes, largest, {d: np.array(x, float) for d, x in fit.items()}), "curve-keys")
    places = stage_table(positions(entries), "curve-places")

    found = window_search(places, classes, k + 1, share, least)
    own = classes.where("asks").select(F.col("c").alias("q"), "c", F.col("ids")[0]["id"].alias("id"),
                                       square.alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id", "c")  # a row found on several curves has one rank
    found = (found.unionByName(own).withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= k + 1)
             .select("q", "c", "score").distinct())
    answers = stage_table(
        found.join(classes.select("c", "ids"), "c")
        .select("q", F.transform("ids", lambda x: F.struct((-F.col("score")).alias("far"), x["id"].alias("id"),
                                                           x["rid"].alias("rid"))).alias("some"))
        .groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k + 1).alias("near")),
        "curve-answers")
    asking = table.where("asks").join(classes.select("v", F.col("c").alias("q")), "v").select("q", "id", "rid")
    near = F.slice(F.filter("near", lambda x: x["rid"] != F.col("rid")), 1, k)
    return (asking.join(answers, "q").select(F.col("id").alias("query_id"), F.posexplode(near).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"),
                    (-F.col("x.far")).alias("score")))


def op13_curve_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(load(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
