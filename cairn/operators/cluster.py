"""Clustering: agglomeration, neighbour layouts, k-means, principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.arrays import METRICS, distance
from cairn.operators.clean import quoted
from cairn.operators.layout import layout as placed
from cairn.operators.linkage import linked

__all__ = ["METRICS", "agglomerative", "distance", "kmeans", "layout", "linkage_labels", "profile", "project"]

#: Rows that agglomeration by manhattan and chebyshev distances takes at most: they are a matrix of 4 bytes a pair (1.6 GB for so many rows).
MOST_ROWS = 20_000


def agglomerative(df: DataFrame, id_column: str, columns: Sequence[str], clusters: int = 3, metric: str = "euclidean", most: int = MOST_ROWS) -> DataFrame:
    """(id, cluster): Ward linkage for euclidean distances, average linkage for cosine, of any number of rows (linkage.py).

    Average linkage by manhattan or chebyshev distances needs all pairs of rows: more than most rows are an error.
    """
    k = max(2, clusters)
    if metric in ("euclidean", "cosine"):
        return linked(df, id_column, F.array(*[quoted(c).cast("double") for c in columns]), k, metric == "euclidean")
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"Average linkage by {metric} distances takes at most {most} rows; take a sample, or the euclidean or cosine metric")
    kind = df.schema[id_column].dataType.simpleString()

    def link(pdf):
        ids, x = _matrix(pdf, len(columns))
        return ids.assign(cluster=linkage_labels(x, min(k, max(1, n)), metric))

    return _bounded(df, id_column, columns).applyInPandas(link, f"id {kind}, cluster int").withColumnRenamed("id", id_column)


def _bounded(df: DataFrame, id_column: str, columns: Sequence[str]):
    """The rows of a bounded sample as one group of (id, x)."""
    return df.select(quoted(id_column).alias("id"), F.array(*[quoted(c).cast("double") for c in columns]).alias("x"), F.lit(0).alias("_all")).groupBy("_all")


def _matrix(pdf, width: int):
    import numpy as np

    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    return pdf[["id"]], np.vstack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, width))


class _Centres:
    """Clusters by their mean: Ward distances of euclidean rows, average cosine distances of rows of unit length."""

    def __init__(self, x, weights, ward: bool) -> None:
        import numpy as np

        if not ward:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        self.x, self.size, self.ward = (x - x.mean(0) if ward and len(x) else x.copy()), weights, ward
        self.square = (self.x * self.x).sum(1)

    def row(self, i: int):
        import numpy as np

        dots = self.x @ self.x[i]
        if not self.ward:
            return 1 - dots
        return np.maximum(self.square + self.square[i] - 2 * dots, 0) * (2 * self.size * self.size[i] / (self.size + self.size[i]))

    def merge(self, i: int, j: int) -> None:
        both = self.size[i] + self.size[j]
        self.x[i] = (self.x[i] * self.size[i] + self.x[j] * self.size[j]) / both
        self.size[i], self.square[i] = both, self.x[i] @ self.x[i]


class _Pairs:
    """Clusters by a matrix of average distances, filled column by column of the rows."""

    def __init__(self, x, weights, largest: bool) -> None:
        import numpy as np

        n = len(x)
        self.d, self.size = np.zeros((n, n), dtype=np.float32), weights
        for c in range(x.shape[1]):
            v = x[:, c].astype(np.float32)
            for at in range(0, n, 1024):
                gap = np.abs(v[at : at + 1024, None] - v[None, :])
                part = self.d[at : at + 1024]
                np.maximum(part, gap, out=part) if largest else np.add(part, gap, out=part)

    def row(self, i: int):
        return self.d[i].copy()

    def merge(self, i: int, j: int) -> None:
        both = self.size[i] + self.size[j]
        new = (self.size[i] * self.d[i] + self.size[j] * self.d[j]) / both
        self.d[i], self.d[:, i] = new, new
        self.size[i] = both


def linkage_labels(x, clusters: int, metric: str, weights=None):
    """Cluster numbers of the rows of a matrix, numbered by first appearance: Ward linkage for euclidean, else average.

    By chains of nearest neighbours: a chain ends in two clusters that are nearest to each other, which merge; for these
    linkages the merges in order of their distances are those of nearest-pair agglomeration. n rows take about n * n * columns.
    """
    import numpy as np

    n = len(x)
    size = np.ones(n) if weights is None else np.asarray(weights, dtype=float).copy()
    space = _Pairs(x, size, metric == "chebyshev") if metric in ("manhattan", "chebyshev") else _Centres(np.asarray(x, dtype=float), size, metric == "euclidean")
    gone = np.zeros(n, dtype=bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmin(gone)))
        i = chain[-1]
        d = space.row(i)
        d[gone] = np.inf
        d[i] = np.inf
        j = int(d.argmin())
        # Of equally near ones the one before in the chain, so that it ends.
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            del chain[-2:]
            keep, drop = min(i, j), max(i, j)
            space.merge(keep, drop)
            gone[drop] = True
            merges.append((float(d[j]), keep, drop))
        else:
            chain.append(j)
    up = np.arange(n)

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = int(up[c])
        return c

    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, n - clusters)]:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    numbers: dict[int, int] = {}
    return np.array([numbers.setdefault(root(c), len(numbers)) for c in range(n)], dtype=np.int32)


def layout(df: DataFrame, id_column: str, columns: Sequence[str], neighbours: int = 15, min_dist: float = 0.1, metric: str = "euclidean", **options: int) -> DataFrame:
    """(id, umap_dimension_1, umap_dimension_2) of any number of rows (layout.py); metrics are those of METRICS, and hamming for one-hot columns. Rows start at their principal components."""
    x = F.array(*[quoted(c).cast("double") for c in columns])
    # Components need two rows and two columns.
    if len(columns) > 1 and df.limit(2).count() > 1:
        return placed(_components(df, columns), id_column, x, F.col("_p")[0], F.col("_p")[1], neighbours, min_dist, metric, **options)
    return placed(df, id_column, x, quoted(columns[0]).cast("double"), F.lit(0.0), neighbours, min_dist, metric, **options)


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_x", array_to_vector(F.array(*[quoted(c).cast("double") for c in columns])))


def kmeans(df: DataFrame, id_column: str, columns: Sequence[str], clusters: int = 3, metric: str = "euclidean", seed: int = 42) -> DataFrame:
    """(id, cluster) by bisecting k-means, for any number of rows; euclidean or cosine."""
    from pyspark.ml.clustering import BisectingKMeans

    model = BisectingKMeans(k=clusters, seed=seed, featuresCol="_x", distanceMeasure=metric).fit(_assembled(df, columns))
    return model.transform(_assembled(df, columns)).select(quoted(id_column), F.col("prediction").alias("cluster"))


def _components(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with the two principal components as an array _p."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    x = _assembled(df, columns)
    return PCA(k=2, inputCol="_x", outputCol="_p").fit(x).transform(x).withColumn("_p", vector_to_array("_p"))


def project(df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """(id, dimension_1, dimension_2): the two principal components."""
    return _components(df, columns).select(quoted(id_column), F.col("_p")[0].alias("dimension_1"), F.col("_p")[1].alias("dimension_2"))


def profile(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """(cluster, n, mean of each column): sizes and means in one aggregation."""
    return df.groupBy(quoted(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c)).alias(c) for c in columns])
