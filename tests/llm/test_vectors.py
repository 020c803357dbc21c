"""Vector codes and hard negatives against plain numpy, with nulls, ties, repeated rows and clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import codes, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, code string, rank int, score double"
NAN, INF = float("nan"), float("inf")


def table(n, dims=16, seed=3, copies=0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.4, (6, dims))
    out = []
    for i in range(n):
        v = (centres[i % 6] + r.normal(0, 0.15, dims)).astype(np.float32) if i >= copies else centres[0].astype(np.float32)
        out.append((i, [float(x) for x in v], int(i % 6) if i % 11 else None, "x", 1, 0.0))
    return out


BAD = [(9001, None, 1, "x", 1, 0.0), (9002, [0.5, None] * 8, 1, "x", 1, 0.0), (9003, [NAN] * 16, 1, "x", 1, 0.0), (9050, [INF] * 16, 1, "x", 1, 0.0), (9005, [], 1, "x", 1, 0.0), (9100, [0.5], 1, "x", 1, 0.0)]


def plain_codes(rows):
    kept = sorted((r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and len(r[1]) == 16), key=lambda r: (r[0] is None, r[0] or 0, [np.floor(4096.0 * x) for x in r[1]]))
    x = np.array([[int(np.floor(4096.0 * c)) for c in r[1]] for r in kept]).reshape(-1, 8, 2)
    books = [[list(map(int, x[i, p])) for i in range(min(16, len(x)))] for p in range(8)]

    def pick(p, row):
        d = [sum((int(a) - b) ** 2 for a, b in zip(row, c)) for c in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(6):
        for p in range(8):
            of = [pick(p, row)[0] for row in x[:, p]]
            for e in range(len(books[p])):
                own = [row for row, k in zip(x[:, p], of) if k == e]
                if own:
                    books[p][e] = [sum(int(r[i]) for r in own) // len(own) for i in range(2)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[pick(p, row[p]) for p in range(8)] for row in x]
    errors = [sum(d for _, d in f) for f in found]
    totals = {}
    for r, e in zip(kept, errors):
        totals[r[2]] = totals.get(r[2], 0) + e
    return sorted((repr(r[0]), "".join(f"{i:02x}" for i, _ in f), e, totals[r[2]], digest) for r, f, e in zip(kept, found, errors))


@pytest.mark.parametrize("rows", [table(120) + BAD + table(120)[:5] + [(None, table(1)[0][1], None, "x", 1, 0.0)], table(9), table(60, copies=40)])
def test_codes(spark, rows):
    got = codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_codes_edges(spark):
    assert codes.compressed(spark.createDataFrame([], SCHEMA)).columns == codes.compressed(spark.createDataFrame(table(3), SCHEMA)).columns
    assert codes.compressed(spark.createDataFrame(BAD[:5], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(spark.createDataFrame([(1, [0.5] * 9, 1, "x", 1, 0.0)], SCHEMA))
    with pytest.raises(Exception, match="component too large"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 16, 1, "x", 1, 0.0)], SCHEMA))


def plain_negatives(rows, dims):
    kept = [(r[0], r[2], [int(np.floor(256.0 * c)) for c in r[1]]) for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and len(r[1]) == dims]
    kept = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in kept]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (a, y, v) in enumerate(kept):
        if a % 50:
            continue
        scores = sorted((-dot(v, w), i, z) for m, (i, z, w) in enumerate(kept) if m != n)
        for s, p, _ in [t for t in scores if t[2] == y][:5]:
            ok = [t for t in scores if t[2] != y and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(ok)]
    return sorted(out)


@pytest.mark.parametrize(("rows", "block"), [(table(400) + BAD + table(400)[48:53] + [(None, table(1)[0][1], 1, "x", 1, 0.0)], 4096), (table(400, seed=5), 3), (table(300, copies=200), 4), (table(8), 2)])
def test_negatives(spark, rows, block, monkeypatch):
    monkeypatch.setattr(negatives, "STEP", 500)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label, block=block).collect()
    want = plain_negatives(rows, 16)
    assert sorted(map(tuple, got)) == want and (want or len(rows) == 8)


def test_negatives_edges(spark):
    label = F.col("label")
    for rows in ([], BAD[:5], [r for r in table(40) if r[0] % 50]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, label).count() == 0


def test_bound_never_loses(spark):
    """Whatever the axes, the bound holds: products of large, almost equal vectors under a bad rotation."""
    r = np.random.default_rng(1)
    x = r.integers(-(1 << 25), 1 << 25, (200, 32)) // 2 + (1 << 24)
    axes = np.linalg.qr(r.normal(size=(32, 32)))[0] + 1e-12
    a = negatives.Rotated(x, axes)
    for lead, rest in zip(a.leads, a.rests):
        bound = a.y[:, :lead] @ a.y[:, :lead].T + np.outer(rest, rest) + negatives.slack(axes) * np.outer(a.norm, a.norm)
        assert (bound >= (x @ x.T).astype(float)).all()
