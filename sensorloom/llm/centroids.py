"""K-means over integer vectors in JVM-native expressions only.

A component x becomes the integer floor(SCALE * x). zip_with and aggregate give the squared distance to each
row of a literal array of centroids, array_min over (distance, number) chooses the cluster (ties: the smaller
number), and one aggregation with a sum column per component moves the centroids to floor(sum / count), exactly.
A round is one pass with a map-side combined aggregation of at most k groups; k rows of sums come back and
become the next literals, so nothing is joined or broadcast and a vector never leaves its task. The rounds end
early when no centroid moved, which gives the same result as going on.

Starts: the k vectors with the smallest sha256 of `<seed>:<id>` (ties: the smaller vector), in that order.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out; a
null id takes part but starts no centroid unless there are too few others; repeated rows are vectors of their
own; with fewer than k vectors there are as many centroids, and with none the result is empty; an empty cluster keeps its
centroid; components beyond +-LIMIT count as that bound, so that squared distances fit in 64 bits; sums of components are
64-bit too, which overflows (and raises) only beyond 6e10 vectors that all stand at the bound. Columns of the
input other than id and vector are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table
from sensorloom.session import materialise

SCALE = 256
#: 64 * (2 * LIMIT) ** 2 stays below 2 ** 63.
LIMIT = 1 << 27


def finite(vector: Column) -> Column:
    """Is every component of a vector there and finite?"""
    return F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def integers(vector: Column, scale: int = SCALE, limit: int = LIMIT) -> Column:
    """array<bigint> of floor(scale * x), held within +-limit."""
    low, high = F.lit(float(-limit)), F.lit(float(limit))
    return F.transform(vector, lambda v: F.floor(F.least(high, F.greatest(low, v.cast("double") * F.lit(float(scale))))))


def integer_vectors(rows: DataFrame, id_column: str, vector: str, dims: int, scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows whose vector has `dims` finite components."""
    v = F.col(vector)
    kept = rows.where(v.isNotNull() & (F.size(v) == dims) & finite(v))
    return kept.select(F.col(id_column).alias("id"), integers(v, scale).alias("x"))


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The first k vectors by hash of their id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["x"] for r in vectors.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()]


def literal(centroids: list[list[int]]) -> Column:
    """array<array<bigint>> literal."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{v}L" for v in c) + ")" for c in centroids) + ")")


def nearest(x: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid."""

    def distance(c: Column) -> Column:
        return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda total, d: total + d)

    return F.array_min(F.transform(literal(centroids), lambda c, i: F.struct(distance(c).alias("distance"), i.alias("cluster"))))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floors of the means of their vectors."""
    dims = len(centroids[0])
    sums = (
        vectors.select(nearest(F.col("x"), centroids)["cluster"].alias("cluster"), *[F.col("x")[j].alias(f"x{j}") for j in range(dims)])
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{j}").alias(f"x{j}") for j in range(dims)])
    )
    out = list(centroids)
    for r in sums.collect():  # at most k rows
        out[r["cluster"]] = [r[f"x{j}"] // r["n"] for j in range(dims)]
    return out


def fit(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> list[list[int]]:
    """Centroids of (id, x) after `rounds` rounds, in the order of their starts."""
    centroids = starts(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        now = moved(vectors, centroids)
        if now == centroids:
            break
        centroids = now
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of each vector."""
    if not centroids:
        return vectors.where("false").select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    near = vectors.select("id", nearest(F.col("x"), centroids).alias("near"))
    return near.select("id", F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance"))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def listed(values: list, kind: str) -> Column:
    return F.expr("array(" + ", ".join(f"CAST('{v}' AS {kind})" for v in values) + ")")


def summarised(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with the inertia of the cluster and of all, and the digest of the centroid."""
    if not centroids:
        empty = F.lit(None).cast("long")
        return assigned.withColumns({"cluster_inertia": empty, "inertia": empty, "centroid_sha256": F.lit(None).cast("string")})
    inertia = [0] * len(centroids)
    for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect():  # at most k rows
        inertia[r["cluster"]] = r["s"]
    return assigned.withColumns({
        "cluster_inertia": F.get(listed(inertia, "BIGINT"), F.col("cluster")),
        "inertia": F.lit(sum(inertia)).cast("long"),
        "centroid_sha256": F.get(listed([digest(c) for c in centroids], "STRING"), F.col("cluster")),
    })


def cluster(rows: DataFrame, id_column: str, vector: str, dims: int, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    vectors = integer_vectors(rows, id_column, vector, dims)
    centroids = fit(vectors, k, rounds, seed)
    return summarised(materialise(assign(vectors, centroids), "centroid-clusters"), centroids)


def _sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64) -> str:
    """The same in SQL: the rounds written out one after the other."""
    near = "SELECT r, vec_id, x, arg_min({{'d': d, 'n': n}}, {{'d': d, 'n': n}}) AS near FROM (SELECT k.*, c.n, list_sum(list_transform(k.x, lambda v, i: (v - c.x[i]) * (v - c.x[i])))::BIGINT AS d FROM kept k CROSS JOIN c{i} c) GROUP BY ALL"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor(least({LIMIT}.0, greatest(-{LIMIT}.0, 256 * CAST(v AS DOUBLE)))) AS BIGINT)) AS x
        FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT n, x FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS n, x FROM kept) WHERE n < {k})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        parts.append(f"""m{i} AS (SELECT n, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY j) AS x FROM (
          SELECT near.n AS n, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS c FROM a{i} CROSS JOIN generate_series(1, {dims}) AS g(j) GROUP BY ALL) GROUP BY n)""")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (n))")
    parts.append(f"last AS MATERIALIZED ({near.format(i=rounds)})")
    return f"""WITH {', '.join(parts)} SELECT vec_id, CAST(near.n AS INTEGER) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.n) AS BIGINT) AS cluster_inertia,
      CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM last JOIN c{rounds} c ON c.n = near.n"""


@query("op11_centroid_clusters", _sql())
def op11_centroid_clusters(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64).withColumnRenamed("id", "vec_id")
