"""Centroid clustering of integer vectors; the nearest centroid by equal-average equal-variance search.

For two vectors of d components with sums S and T and spreads U and V (root of the sum of squared differences
from the own mean), d * distance >= (S - T)**2 + d * (U - V)**2. Centroids are sorted by their sum. The search for a
vector starts at the place of its own sum and goes outward, always to the side whose sum is nearer. A side ends
where the first term alone exceeds the best distance; a centroid is passed over where both terms do. What is left is
computed in whole numbers, and equal distances go to the smaller number. So the result is exact; the bounds
are taken with room for rounding, which only means some more distances.

Each round is one pass: tasks assign their vectors and give sums for each centroid, Spark adds the sums, and the
driver gets ``k`` centroids. Sums are cut into limbs of 32 bits, so components may be of any size: vectors beyond
2**27 are compared with all centroids in Python's integers.

Defined results: vectors with another number of components, a null or a non-finite one are left out; repeated ids are
vectors of their own, and start as centroids in the order of their components; a null id is hashed as an empty one;
fewer than ``k`` vectors make fewer clusters; a distance or inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerlab.session import materialise

WIDTH = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Beyond this, squared distances of WIDTH components may not fit 64 bits.
_SMALL = 1 << 27
_LIMB = 1 << 32
_LONG = (1 << 63) - 1


@dataclass
class Centroids:
    """Centroids as Python integers, and as arrays sorted by sum."""

    rows: list[list[int]]
    order: np.ndarray = field(init=False)
    values: np.ndarray = field(init=False)
    sums: np.ndarray = field(init=False)
    spreads: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        small = all(-_SMALL <= x <= _SMALL for row in self.rows for x in row)
        values = np.array(self.rows, dtype=np.int64 if small else object)
        sums = values.sum(axis=1)
        self.order = np.array(sorted(range(len(self.rows)), key=lambda c: (sums[c], c)))
        self.values, self.sums = values[self.order], sums[self.order]
        self.spreads = _spreads(self.values, self.sums) if small else None


def _spreads(values: np.ndarray, sums: np.ndarray) -> np.ndarray:
    apart = values.astype(float) - (sums.astype(float) / values.shape[1])[:, None]
    return np.sqrt((apart * apart).sum(axis=1))


def nearest(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, distances computed) of every row of integers."""
    count, width = vectors.shape
    values = centroids.values
    if vectors.dtype == object or values.dtype == object:
        rows = zip(centroids.order.tolist(), values.tolist(), strict=True)
        far = [(((vectors - np.array(row, object)) ** 2).sum(axis=1), name) for name, row in rows]
        pairs = [min((row[i], name) for row, name in far) for i in range(count)]
        distances = np.array([distance for distance, _ in pairs], object)
        return np.array([name for _, name in pairs], np.int64), distances, count * len(values)
    sums = vectors.sum(axis=1)
    spreads = _spreads(vectors, sums)
    own, held = sums.astype(float), centroids.sums.astype(float)
    # Rounding errors of sums and spreads stay far below these.
    slack_of = 1e-9 * (np.abs(own) + width * spreads + 1)
    slack_to = 1e-9 * (np.abs(held) + width * centroids.spreads + 1)
    best = np.full(count, np.inf)
    found, number = np.zeros(count, np.int64), np.full(count, len(values))
    right = np.searchsorted(held, own)
    left = right - 1
    alive, computed = np.arange(count), 0
    while len(alive):
        low, high = left[alive], right[alive]
        below = np.where(low >= 0, np.abs(own[alive] - held[np.maximum(low, 0)]), np.inf)
        above = np.where(high < len(held), np.abs(held[np.minimum(high, len(held) - 1)] - own[alive]), np.inf)
        down = below <= above
        at = np.where(down, low, high)
        apart = np.minimum(below, above)
        inside = np.isfinite(apart)
        alive, at, apart, down = alive[inside], at[inside], apart[inside], down[inside]
        slack = slack_of[alive] + slack_to[at]
        means = np.maximum(apart - slack, 0) ** 2
        # All further centroids are at least as far off by their sums, on either side.
        near = means <= width * best[alive] * (1 + 1e-9)
        alive, at, down, means, slack = alive[near], at[near], down[near], means[near], slack[near]
        left[alive[down]] -= 1
        right[alive[~down]] += 1
        spread = np.maximum(np.abs(spreads[alive] - centroids.spreads[at]) - slack, 0) ** 2
        close = means + width * spread <= width * best[alive] * (1 + 1e-9)
        who, which = alive[close], at[close]
        if len(who):
            differences = vectors[who] - values[which]
            distance = (differences * differences).sum(axis=1)
            computed += len(who)
            name = centroids.order[which]
            first = number[who] == len(values)
            better = first | (distance < found[who]) | ((distance == found[who]) & (name < number[who]))
            who, distance, name = who[better], distance[better], name[better]
            found[who], number[who], best[who] = distance, name, distance.astype(float)
    return number, found, computed


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are small, their integers; the others as objects) of arrays of WIDTH finite doubles."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) * float(scale))
    return flat, (np.abs(flat) <= _SMALL).all(axis=1) & np.isfinite(flat).all(axis=1)


def _parts(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors): the small ones as int64, the others as Python integers."""
    if not len(column):
        return
    flat, small = _integers(column, scale)
    at = np.flatnonzero(small)
    if len(at):
        yield at, flat[at].astype(np.int64)
    at = np.flatnonzero(~small)
    if len(at):
        raw = column.take(pa.array(at)).to_pylist()
        # In whole numbers: the double times the scale can be beyond all doubles.
        yield at, np.array([[_floor(x, scale) for x in row] for row in raw], dtype=object)


def _floor(value: float, scale: int) -> int:
    over, under = value.as_integer_ratio()
    return over * scale // under


def _limbs(value: int) -> list[int]:
    """Digits of an integer to the base 2**32, all with its sign."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value % _LIMB))
        value //= _LIMB
    return out or [0]


def _kept(vectors: DataFrame, vec_id: str, embedding: str, width: int) -> DataFrame:
    doubles = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    read = vectors.select(F.col(vec_id).alias("vec_id"), doubles.alias("v"))
    return read.where((F.size("v") == width) & F.coalesce(finite, F.lit(False)))


def _first(kept: DataFrame, clusters: int, scale: int, seed: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select("v", order.alias("h")).orderBy("h", "v").limit(clusters).collect()
    return [[_floor(x, scale) for x in row["v"]] for row in rows]


def _sums(kept: DataFrame, centroids: Centroids, scale: int) -> DataFrame:
    """(cluster, place, limb, total): the sums of the vectors of every cluster; place -1 counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Added up over the whole task in Python's integers.
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, vectors in _parts(batch.column("v"), scale):
                number, _, _ = nearest(vectors, centroids)
                for cluster in np.unique(number).tolist():
                    own = vectors[number == cluster]
                    for place, total in enumerate(own.sum(axis=0).tolist()):
                        totals[cluster, place] = totals.get((cluster, place), 0) + total
                    totals[cluster, -1] = totals.get((cluster, -1), 0) + len(own)
        rows = [(c, p, i, limb) for (c, p), total in totals.items() for i, limb in enumerate(_limbs(total))]
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["cluster", "place", "limb", "total"])

    parts = kept.select("v").mapInArrow(run, "cluster int, place int, limb int, total long")
    return parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _moved(rows: list, centroids: Centroids) -> Centroids:
    totals: dict[tuple[int, int], int] = {}
    for row in rows:
        key = row["cluster"], row["place"]
        totals[key] = totals.get(key, 0) + int(row["total"]) * _LIMB ** row["limb"]
    out = []
    for cluster, old in enumerate(centroids.rows):
        count = totals.get((cluster, -1), 0)
        out.append([totals[cluster, place] // count for place in range(len(old))] if count else old)
    return Centroids(out)


def _assigned(kept: DataFrame, centroids: Centroids, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters = np.zeros(batch.num_rows, np.int32)
            distances: np.ndarray = np.zeros(batch.num_rows, object)
            for at, vectors in _parts(batch.column("v"), scale):
                number, found, _ = nearest(vectors, centroids)
                clusters[at], distances[at] = number, found
            fits = pa.array([int(d) if d <= _LONG else None for d in distances.tolist()], pa.int64())
            columns = [batch.column("vec_id"), pa.array(clusters), fits]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid."""
    spark = vectors.sparkSession
    kept = materialise(_kept(vectors, vec_id, embedding, width))
    first = _first(kept, clusters, scale, seed)
    kind = kept.schema["vec_id"].dataType.simpleString()
    result = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid string"
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, {result}")
    centroids = Centroids(first)
    for _ in range(rounds):
        centroids = _moved(_sums(kept, centroids, scale).collect(), centroids)
    assigned = materialise(_assigned(kept, centroids, scale))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    # One that does not fit makes its sums unknown too.
    total = F.when(F.count("distance") == F.count(F.lit(1)), total)
    sums = {row["cluster"]: row["total"] for row in assigned.groupBy("cluster").agg(total.alias("total")).collect()}
    whole = None if None in sums.values() else sum(sums.values())
    fits = lambda x: None if x is None or x > _LONG else int(x)
    told = []
    for number, row in enumerate(centroids.rows):
        text = ",".join(map(str, row))
        if number in sums:
            told.append((number, fits(sums[number]), fits(whole), hashlib.sha256(text.encode()).hexdigest(), text))
    kinds = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid string"
    # At most one row for each centroid.
    return assigned.join(F.broadcast(spark.createDataFrame(told, kinds)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )


def _oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of all rounds: every distance written out in whole numbers."""
    parts = [
        """kept AS MATERIALIZED (
             SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) AS rank, v
             FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
             WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """x AS MATERIALIZED (SELECT rank, unnest(range(1, 65)) AS d,
             unnest(list_transform(v, lambda x: CAST(floor(1024 * x) AS HUGEINT))) AS x FROM kept)""",
        "c0 AS MATERIALIZED (SELECT CAST(rank - 1 AS INTEGER) AS c, d, x FROM x WHERE rank <= 8)",
    ]
    for step in range(rounds + 1):
        parts.append(f"""p{step} AS MATERIALIZED (
             SELECT rank, arg_min(c, struct_pack(far := far, c := c)) AS c, min(far) AS far
             FROM (SELECT x.rank, k.c, sum((x.x - k.x) * (x.x - k.x)) AS far FROM x JOIN c{step} k ON k.d = x.d GROUP BY ALL)
             GROUP BY rank)""")
        if step < rounds:
            parts.append(f"""c{step + 1} AS MATERIALIZED (
             SELECT k.c, k.d, coalesce(m.x, k.x) AS x FROM c{step} k LEFT JOIN (
               SELECT p.c, x.d, (sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
               FROM x JOIN p{step} p ON p.rank = x.rank GROUP BY ALL) m ON m.c = k.c AND m.d = k.d)""")
    return f"""WITH {", ".join(parts)}
SELECT k.vec_id, p.c AS cluster, CAST(p.far AS BIGINT) AS distance,
       CAST(sum(p.far) OVER (PARTITION BY p.c) AS BIGINT) AS cluster_inertia, CAST(sum(p.far) OVER () AS BIGINT) AS inertia,
       t.told AS centroid_sha256
FROM kept k JOIN p{rounds} p ON p.rank = k.rank
JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS told FROM c{rounds} GROUP BY c) t ON t.c = p.c
"""


ORACLE_SQL = _oracle()
