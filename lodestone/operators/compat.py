"""Estimators under widely used names: thin constructors around the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.stats import covariance_matrix
from lodestone.operators.cluster import DBSCAN, KMeans  # noqa: F401
from lodestone.operators.decomp import PCA, TSNE, KernelPCA  # noqa: F401
from lodestone.operators.linear import LinearModel
from lodestone.operators.neighbors import ApproximateNeighbors, NearestNeighbors
from lodestone.operators.pairs import pairwise_distances  # noqa: F401
from lodestone.operators.split import train_test_split  # noqa: F401
from lodestone.operators.svm import SVC, SVR, NuSVC, NuSVR  # noqa: F401
from lodestone.operators.trees import DecisionTree, RandomForest


def LinearRegression(fit_intercept: bool = True, **options) -> LinearModel:
    return LinearModel(mod="mse", intercept=fit_intercept, **options)


def Ridge(alpha: float = 1.0, fit_intercept: bool = True, **options) -> LinearModel:
    return LinearModel(mod="mse", intercept=fit_intercept, reg_lambda=alpha, **options)


def Lasso(alpha: float = 1.0, fit_intercept: bool = True, **options) -> LinearModel:
    return LinearModel(mod="mse", intercept=fit_intercept, reg_lambda=alpha, reg_alpha=1.0, **options)


def ElasticNet(alpha: float = 1.0, l1_ratio: float = 0.5, fit_intercept: bool = True, **options) -> LinearModel:
    return LinearModel(mod="mse", intercept=fit_intercept, reg_lambda=alpha, reg_alpha=l1_ratio, **options)


def LogisticRegression(C: float = 1.0, fit_intercept: bool = True, **options) -> LinearModel:
    return LinearModel(mod="logistic", intercept=fit_intercept, reg_lambda=1.0 / C, **options)


def DecisionTreeClassifier(max_depth: int = 29, **options) -> DecisionTree:
    return DecisionTree(max_depth=max_depth, **options)


def RandomForestClassifier(n_estimators: int = 100, **options) -> RandomForest:
    return RandomForest(n_trees=n_estimators, **options)


def KNeighborsClassifier(n_neighbors: int = 5, **options) -> NearestNeighbors:
    return NearestNeighbors(n_neighbors=n_neighbors, **options)


KNeighborsRegressor = KNeighborsClassifier


def RadiusNeighborsClassifier(radius: float = 1.0, **options) -> NearestNeighbors:
    return NearestNeighbors(radius=radius, **options)


RadiusNeighborsRegressor = RadiusNeighborsClassifier


class EmpiricalCovariance:
    def __init__(self, assume_centered: bool = False):
        self.assume_centered = assume_centered

    def fit(self, df: DataFrame, columns: list[str]) -> EmpiricalCovariance:
        """covariance_ is (row, col, value) with divisor n."""
        self.covariance_ = covariance_matrix(df, columns, -1, self.assume_centered)
        return self


class IndexFlatL2:
    """Exact search by squared Euclidean distance over added rows (id and an array x)."""

    def __init__(self, d: int):
        self.d, self.rows = d, None

    is_trained = True

    @property
    def ntotal(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def train(self, df: DataFrame) -> None:
        pass

    def add(self, df: DataFrame) -> None:
        df = df.select("id", "x")
        self.rows = df if self.rows is None else self.rows.unionByName(df)

    def search(self, df: DataFrame, k: int) -> DataFrame:
        return NearestNeighbors(n_neighbors=k, metric="sqeuclidean").fit(self.rows).kneighbors(df)

    def assign(self, df: DataFrame, k: int = 1) -> DataFrame:
        return self.search(df, k).select("id_x", "rank", "id_y")

    def reconstruct_batch(self, ids: list[int]) -> DataFrame:
        return self.rows.where(F.col("id").isin(ids))

    def reconstruct(self, i: int) -> DataFrame:
        return self.reconstruct_batch([i])

    def reset(self) -> None:
        self.rows = None


class IndexIVFFlat(ApproximateNeighbors):
    """Inverted file with nprobe lists searched."""

    def __init__(self, d: int = 0, nlist: int = 1, metric: str = "sqeuclidean", nprobe: int = 1):
        super().__init__(n_list=nlist, metric=metric, n_probe=nprobe)
        self.d = d

    @property
    def ntotal(self) -> int:
        return 0 if getattr(self, "index", None) is None else self.index.count()

    def search(self, df: DataFrame, k: int) -> DataFrame:
        return self.kneighbors(df, k)

    def reset(self) -> None:
        self.index = None


def index_factory(d: int, description: str):
    """Flat, or IVF<n>,Flat."""
    if description == "Flat":
        return IndexFlatL2(d)
    head, _, tail = description.partition(",")
    if head.startswith("IVF") and head[3:].isdigit() and tail == "Flat":
        return IndexIVFFlat(d, int(head[3:]))
    raise ValueError("descriptions are Flat and IVF<n>,Flat")


class Kmeans:
    """Clustering with FAISS's names: train, centroids, obj (the cost of the fit), assign and an index over the centroids."""

    def __init__(self, d: int, k: int, niter: int = 25, nredo: int = 1, spherical: bool = False, seed: int = 1234, verbose: bool = False):
        self.d, self.k, self.index = d, k, None
        self.model = KMeans(n_clusters=k, max_iter=niter, n_init=nredo, seed=seed, initialization_method="random", distance="cosine" if spherical else "euclidean", normalize_data=spherical)

    def train(self, df: DataFrame) -> float:
        """df: id and an array x. Gives the final cost."""
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore", UserWarning)  # niter is a budget, not a failure
            self.model.fit(df)
        self.centroids, self.obj = self.model.cluster_centres, self.model.inertia
        self.index = IndexFlatL2(self.d)
        self.index.add(df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(self.centroids)], "id long, x array<double>"))
        return self.obj

    def assign(self, df: DataFrame) -> DataFrame:
        """id, D (squared distance to the nearest centroid, or one less the cosine) and I (its number)."""
        label, least = self.model._label_columns(self.centroids)
        return self.model._ready(df).select("id", least.alias("D"), label.alias("I"))


def get_version() -> str:
    import lodestone

    return lodestone.__version__


def get_arch_info(spark) -> DataFrame:
    """One row: what the session computes with."""
    return spark.createDataFrame([(spark.version, spark.sparkContext.master, spark.sparkContext.defaultParallelism)], "spark string, master string, parallelism int")
