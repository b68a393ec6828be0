"""Hard negatives, the Merkle manifest and curve neighbours against brute force,
with nulls, non-finite and zero vectors, ties, repeated rows, a vector that a
third of the rows share, clashing columns and empty tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("arbor.llm")

from arbor.llm import curve_neighbours as C  # noqa: E402
from arbor.llm import hard_negatives as H  # noqa: E402
from arbor.llm import merkle as M  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, rid long, score double, id string, c long, __id int"


def _vectors(n=420, dims=8):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n, dims)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base[rng.random(n) < 0.3] = base[0]  # a hot vector
    rows = [(int(k), [float(x) for x in base[k]], int(rng.integers(0, 5))) for k in range(n)]
    rows += [(20, rows[20][1], rows[20][2])] * 2  # repeated rows
    rows += [(1000, None, 1), (1001, [1.0, None], 1), (1002, [math.nan] * dims, 2), (1003, [math.inf] + [0.0] * (dims - 1), 2),
             (1004, [0.0] * dims, 3), (1005, [], 4), (None, rows[5][1], 1), (1006, rows[6][1], None), (1007, [2.0, 1.0], 1),
             (1050, [1.0, 2.0], 1), (1060, [1.5, 2.5], 2), (1100, [-x for x in rows[3][1]], 1)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    rows = _vectors()
    return rows, spark.createDataFrame([(*r, 1, 0.5, "x", 2, 3) for r in rows], SCHEMA).repartition(5)


def _mined(rows, anchor, pos=5, neg=3):
    ok = [(k, r[0], [math.floor(256 * x) for x in r[1]], r[2]) for k, r in enumerate(rows)
          if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for k, i, v, y in ok:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z, q) for q, j, w, z in ok if q != k and len(w) == len(v))
        for s, j, _, _ in [x for x in scored if x[2] == y][:pos]:
            inside = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:neg]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("group", [None, 3])
def test_hard_negatives_equal_brute_force(vectors, group):
    rows, df = vectors
    got = H.mine(df, F.col("id") % 10 == 0, group=group)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows, lambda i: i % 10 == 0)
    assert H.mine(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert H.mine(df, F.col("id") < 0).count() == 0


@pytest.mark.parametrize("size,dims", [(3, 4), (10**4, 700), (2**26, 64)])
def test_residue_products_are_exact(size, dims):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size, (7, dims)), rng.integers(-size, size, (9, dims))
    primes = H.primes_for(int(max((a * a).sum(1).max(), (b * b).sum(1).max())))
    got = H.product(H.residues(a, primes), H.residues(b, primes), primes)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert got.tolist() == want and all(p > 200 and all(p % d for d in range(2, p)) for p in primes)


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    """Root, and for each leaf the siblings of each level as (before, after)."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            lo = a // 16 * 16
            paths[k].append((nodes[lo:a], nodes[a + 1:lo + 16]))
        nodes = [_h(nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], paths


def _manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done, subroots = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, _h(map(field, r))))
        root, paths = _tree([_h(map(field, r)) for r in own])
        subroots.append(root)
        done.append([(r, p) for r, p in zip(own, paths)])
    root, upper = _tree(subroots)
    out = []
    for members, sub, top in zip(done, subroots, upper):
        for r, path in members:
            whole = path + top
            low = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            seen = r[:4] + ((r[4].translate({c: c + 32 for c in range(65, 91)}),) if low else (r[4],))
            h = _h(map(field, seen))
            for before, after in whole:
                h = _h([*before, h, *after])
            out.append((r[0], _h(map(field, r)), sub, root, _h(x for b, a in whole for x in (*b, *a)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("case", ["many", "one source", "one row", "runs"])
def test_merkle_equals_brute_force(spark, case):
    rnd = random.Random(4)
    text = lambda: rnd.choice([None, "", "Ab Ñ É", "x" * 9000, "plain", "Mixed\nCase 中文 😀"])
    sources = {"many": [None, "", "a", "b", "é", "Z"] + [f"s{k}" for k in range(30)], "one source": ["a"], "one row": ["a"],
               "runs": [f"r{k}" for k in range(3)]}[case]
    sizes = {"many": 330, "one source": 289, "one row": 1, "runs": 51}[case]
    rows = [(k if k % 17 else None, "a" if case == "many" and k % 3 == 0 else sources[k % len(sources)], rnd.choice(["en", None]),
             rnd.choice([k, None]), text()) for k in range(sizes)]
    if case == "many":
        rows += [rows[3]] * 40 + [(rows[4][0], rows[4][1], "en", 1, "another")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, h int, tree string, rid string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = M.manifest(df.repartition(4), tampered={"text": F.when(hit, low).otherwise(F.col("text"))})
    got = [(*r, r.folded_root == r.root) for r in out.collect()]
    assert sorted(got, key=repr) == _manifest(rows)


def test_merkle_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert M.manifest(df).count() == 0


def _near(rows, asks, k):
    ok = [(p, r[0], np.array(r[1], float)) for p, r in enumerate(rows) if r[0] is not None and r[1] and all(
        x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    out = {}
    for p, i, v in ok:
        if asks(i):
            scored = sorted((-float(C.inner(v[None], w[None])[0]), j) for q, j, w in ok if q != p and len(w) == len(v))
            out.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return out


def test_neighbours_equal_brute_force_where_windows_hold_all_rows(vectors):
    rows, df = vectors
    got = {}
    for r in C.neighbours(df, F.col("id") % 20 == 0, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = _near(rows, lambda i: i % 20 == 0, 7)
    assert set(got) == {i for i, x in want.items() if any(x)}
    for i, found in got.items():
        # rows under one id have equal vectors here, so their lists are alike but for their own row
        flat = sorted((r + 1, j, s) for x in want[i] for r, (j, s) in enumerate(x))
        assert sorted(found) == flat
    assert C.neighbours(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert C.neighbours(df, F.col("id") < 0).count() == 0


def test_narrow_windows_keep_recall(spark, monkeypatch):
    """Blocks far smaller than the table: clustered vectors of any length."""
    monkeypatch.setattr(C, "BLOCK", 64)
    monkeypatch.setattr(C, "QUERIES", 16)
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(60, 24))
    x = (middle[rng.integers(0, 60, 4000)] + 0.4 * rng.normal(size=(4000, 24))) * rng.uniform(0.8, 1.2, (4000, 1))
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in C.neighbours(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3)])
def test_hilbert_visits_every_cell_by_single_steps(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    key = C.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()
