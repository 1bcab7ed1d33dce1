"""Centroid clustering against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlab.llm import centroids


def plain(rows, clusters=8, rounds=10, width=64):
    """Rows (id, cluster, distance, cluster inertia, inertia, digest)."""
    kept = []
    for own, vector in rows:
        if vector is not None and len(vector) == width and all(x is not None and abs(x) < float("inf") for x in vector):
            kept.append((own, vector, [centroids._floor(x, 1024) for x in vector]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [r[2] for r in order[:clusters]]
    for step in range(rounds + 1):
        found = []
        for _, _, v in kept:
            found.append(min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), i) for i, c in enumerate(centres)))
        if step < rounds:
            for i in range(len(centres)):
                own = [r[2] for r, f in zip(kept, found, strict=True) if f[1] == i]
                if own:
                    centres[i] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    distances = [fits(f[0]) for f in found]
    sums = {}
    for f, d in zip(found, distances, strict=True):
        sums[f[1]] = None if d is None or sums.get(f[1], 0) is None else sums.get(f[1], 0) + d
    whole = None if None in sums.values() else sum(sums.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    out = [(r[0], f[1], d, fits(sums[f[1]]), fits(whole), digest[f[1]]) for r, f, d in zip(kept, found, distances, strict=True)]
    return sorted(out, key=repr)


def frame(spark, rows, kind="double"):
    made = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)
    return made.withColumns({c: F.lit("x") for c in ("cluster", "v", "distance", "centroid", "total", "h")})


def vectors(count, seed=1, spread=0.3):
    chance = random.Random(seed)
    middles = [[chance.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [m + chance.gauss(0, spread) for m in chance.choice(middles)]) for i in range(count)]


def odd_rows():
    rows = vectors(120)
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None])]
    rows += [(205, [float("nan")] + [0.0] * 63), (206, [float("inf")] + [0.0] * 63), (207, [-float("inf")] * 64)]
    # Ties, repeated rows and ids, a null id, vectors far off.
    rows += [(208, [0.0] * 64), (209, [0.0] * 64), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    return rows


def result(found):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(row) for row in found.select(names).collect()), key=repr)


def test_equals_plain(spark):
    rows = odd_rows()
    assert result(centroids.cluster_vectors(frame(spark, rows))) == plain(rows)


def test_floats_and_fewer_vectors_than_clusters(spark):
    rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in vectors(5)]
    assert result(centroids.cluster_vectors(frame(spark, rows, "float"))) == plain(rows)


def test_huge_components(spark):
    """Distances of more than 64 bits are compared in whole numbers; what does not fit a long is null."""
    rows = vectors(30) + [(100 + i, [x * 1e200 for x in v]) for i, v in vectors(20, 2)]
    rows += [(300 + i, [x * 1e7 for x in v]) for i, v in vectors(20, 3)] + [(400, [1.7e308] * 64), (401, [-1.7e308] * 64)]
    rows += [(500 + i, [x * 1e4 for x in v]) for i, v in vectors(20, 4)]
    found = result(centroids.cluster_vectors(frame(spark, rows), rounds=3))
    assert found == plain(rows, rounds=3)
    assert any(r[2] is None for r in found) and any(r[2] is not None for r in found)


def test_all_equal_and_empty(spark):
    rows = [(i, [0.5] * 64) for i in range(40)]
    assert result(centroids.cluster_vectors(frame(spark, rows))) == plain(rows)
    assert centroids.cluster_vectors(frame(spark, [])).collect() == []
    assert centroids.cluster_vectors(frame(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exact_and_skips(seed):
    chance = np.random.default_rng(seed)
    held = np.unique(chance.integers(-900, 900, (200, 64)) + chance.integers(-400, 400, (200, 1)), axis=0)
    chance.shuffle(held)
    held[7] = held[11]
    asked = np.concatenate([held[chance.integers(0, len(held), 300)] + chance.integers(-60, 60, (300, 64)), held])
    number, distance, computed = centroids.nearest(asked, centroids.Centroids(held.tolist()))
    apart = ((asked[:, None, :] - held[None, :, :]) ** 2).sum(axis=2)
    assert number.tolist() == apart.argmin(axis=1).tolist()
    assert distance.tolist() == apart.min(axis=1).tolist()
    assert computed < apart.size / 3
