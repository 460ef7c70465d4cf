"""Customer segmentation: train (scaler -> PCA -> KMeans), name clusters,
and score with explicit model parameters.

Scoring does not call back into Python: the fitted parameters (feature
means and deviations, the PCA matrix, the cluster centres; a few hundred
numbers) become literal column expressions, so distances, the softmax
confidence and the chosen cluster are computed inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.features import FEATURE_ORDER

# Segment descriptions and the description template ------------
SEGMENT_DESCRIPTIONS = {
    "investor": "Nasabah dengan sinyal ketertarikan investasi dan saldo rata-rata tinggi.",
    "low_activity": "Nasabah dengan frekuensi transaksi dan penggunaan fitur yang masih rendah.",
    "digital_spender": "Nasabah yang aktif melakukan top-up dan transaksi digital/e-wallet.",
    "bill_payer": "Nasabah yang rutin melakukan pembayaran tagihan dan cocok untuk auto-debit.",
}
DEFAULT_DESCRIPTION = "Segmen nasabah berdasarkan model clustering."
NO_DOMINANT_FEATURE = "aktivitas mobile banking"
SEGMENT_NAMES = ("investor", "bill_payer", "digital_spender", "low_activity")


@dataclass
class SegmentModel:
    """Parameters of a fitted scaler -> PCA -> KMeans pipeline."""
    mean: list[float]
    std: list[float]
    components: list[list[float]]  # len(FEATURE_ORDER) rows x k_pca columns
    centers: list[list[float]]     # n_clusters rows x k_pca columns
    names: list[str]               # segment name of each cluster
    features: list[str] = field(default_factory=lambda: list(FEATURE_ORDER))


def fit_pipeline(features: DataFrame, k: int = 4, pca_k: int = 3, seed: int = 7):
    assembler = VectorAssembler(inputCols=FEATURE_ORDER, outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True)
    pca = PCA(k=pca_k, inputCol="scaled", outputCol="pca")
    kmeans = KMeans(k=k, seed=seed, featuresCol="pca", predictionCol="cluster")
    return Pipeline(stages=[assembler, scaler, pca, kmeans]).fit(features)


def name_clusters(assigned: DataFrame, n_clusters: int) -> list[str]:
    """Name clusters one-to-one from their mean raw features, greedily:
    highest investment activity -> investor, then highest payment ratio ->
    bill_payer, then highest top-up + qris ratio -> digital_spender, the rest
    low_activity. The per-cluster means are one small aggregate (k rows)."""
    means = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(
        F.avg("investment_activity").alias("inv"), F.avg("payment_ratio").alias("pay"),
        (F.avg("topup_ratio") + F.avg("qris_ratio")).alias("dig")).collect()}
    names = ["low_activity"] * n_clusters
    free = [c for c in range(n_clusters)]
    for label, key in (("investor", "inv"), ("bill_payer", "pay"), ("digital_spender", "dig")):
        if not free:
            break
        best = max(free, key=lambda c: (means[c][key] if c in means and means[c][key] is not None else -1.0, -c))
        names[best] = label
        free.remove(best)
    return names


def train_segments(features: DataFrame, k: int = 4, pca_k: int = 3, seed: int = 7):
    """Fit the pipeline and name its clusters. Returns (PipelineModel,
    SegmentModel, silhouette).

    The scaler, PCA, KMeans (several passes), naming and silhouette all read
    the features again, so they are checkpointed once first: the passes
    read the written copy instead of re-running the feature joins, and the
    lineage no longer reaches back to the raw tables.
    """
    from tessera.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(features.sparkSession)
    features = features.select("customer_id", *FEATURE_ORDER).checkpoint(eager=True)
    pm = fit_pipeline(features, k, pca_k, seed)
    assigned = pm.transform(features)
    names = name_clusters(assigned, k)
    silhouette = ClusteringEvaluator(featuresCol="pca", predictionCol="cluster").evaluate(assigned)
    return pm, model_params(pm, names), silhouette


def model_params(pm, names: list[str]) -> SegmentModel:
    scaler, pca, kmeans = pm.stages[1], pm.stages[2], pm.stages[3]
    pc = pca.pc.toArray()
    return SegmentModel(mean=[float(x) for x in scaler.mean], std=[float(x) for x in scaler.std],
                        components=[[float(v) for v in row] for row in pc],
                        centers=[[float(v) for v in c] for c in kmeans.clusterCenters()], names=list(names))


def cluster_summary(features: DataFrame, pm, model: SegmentModel, silhouette: float) -> DataFrame:
    """One row per cluster: name, members, silhouette of the whole model."""
    assigned = pm.transform(features.select("customer_id", *FEATURE_ORDER))
    names = F.element_at(F.array(*[F.lit(n) for n in model.names]), (F.col("cluster") + 1).cast("int"))
    return (assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("customers"))
            .select("cluster", names.alias("segment_name"), "customers", F.lit(silhouette).alias("silhouette")))


# -- scoring expressions ---------------------------------------------------------
def _lit(v: float) -> Column:
    return F.lit(float(v))


def projection(model: SegmentModel) -> list[Column]:
    """PCA coordinates of the standardised features (zero-variance inputs
    scale to 0, as Spark's StandardScaler does)."""
    z = []
    for i, name in enumerate(model.features):
        if model.std[i] == 0:
            z.append(None)
        else:
            z.append((F.col(name) - _lit(model.mean[i])) / _lit(model.std[i]))
    coords = []
    for j in range(len(model.centers[0])):
        acc = None
        for i, zi in enumerate(z):
            if zi is None:
                continue
            term = zi * _lit(model.components[i][j])
            acc = term if acc is None else acc + term
        coords.append(acc if acc is not None else F.lit(0.0))
    return coords


def score_segments(features: DataFrame, model: SegmentModel) -> DataFrame:
    """Nearest centre (ties to the lower cluster index), softmax of negative
    distances as confidence (2 decimals, half to even), segment name and the
    description text. ``features`` is :func:`model_features` output.

    The coordinates form one array and the distances another
    (``transform`` / ``zip_with`` / ``aggregate`` over the literal centres),
    so every later step refers to a single column: the expression stays
    linear in size even when the optimizer inlines projections or pushes a
    filter on ``confidence`` through them.
    """
    coords = F.array(*projection(model))
    centers = F.array(*[F.array(*[_lit(v) for v in c]) for c in model.centers])
    zero = F.lit(0.0)
    dist = F.transform(centers, lambda c: F.sqrt(F.aggregate(
        F.zip_with(F.col("_p"), c, lambda a, b: (a - b) * (a - b)), zero, lambda acc, x: acc + x)))
    scored = features.select("*", coords.alias("_p")).select("*", dist.alias("_d"))
    nearest = F.array_min("_d")
    denom = F.aggregate("_d", zero, lambda acc, x: acc + F.exp(-x))
    with_cluster = scored.select("*", (F.array_position("_d", nearest) - 1).cast("int").alias("cluster"),
                                 F.bround(F.exp(-nearest) / denom, 2).alias("confidence"))
    names = F.array(*[F.lit(x) for x in model.names])
    seg = F.element_at(names, F.col("cluster") + 1)
    keys = [c for c in ("customer_pk", "customer_id") if c in features.columns]
    return with_cluster.select(
        *keys, "cluster", seg.alias("segment_name"), "confidence",
        description(seg, F.col("dominant_feature"), F.col("total_activity")).alias("description"))


def description(segment_name: Column, dominant: Column, total: Column) -> Column:
    base = F.lit(DEFAULT_DESCRIPTION)
    for name, text in SEGMENT_DESCRIPTIONS.items():
        base = F.when(segment_name == name, F.lit(text)).otherwise(base)
    dom = F.when(F.coalesce(dominant, F.lit("")) == "", F.lit(NO_DOMINANT_FEATURE)).otherwise(dominant)
    return F.concat(base, F.lit(" Fitur dominan: "), dom, F.lit(". Total aktivitas terdeteksi: "),
                    total.cast("string"), F.lit("."))


# -- the same scoring as SQL text (oracle) ---------------------------------------
def _num(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def score_sql(model: SegmentModel, source: str) -> str:
    """SELECT computing :func:`score_segments` over ``source`` (a relation
    with the model-feature columns), in the same arithmetic order."""
    z = []
    for i, name in enumerate(model.features):
        z.append(None if model.std[i] == 0 else f"(({name} - {_num(model.mean[i])}) / {_num(model.std[i])})")
    coords = []
    for j in range(len(model.centers[0])):
        acc = None
        for i, zi in enumerate(z):
            if zi is None:
                continue
            term = f"({zi} * {_num(model.components[i][j])})"
            acc = term if acc is None else f"({acc} + {term})"
        coords.append(acc or "0.0")
    dist = []
    for center in model.centers:
        acc = None
        for j, cj in enumerate(center):
            d = f"(p{j} - {_num(cj)})"
            acc = f"({d} * {d})" if acc is None else f"({acc} + ({d} * {d}))"
        dist.append(f"sqrt({acc})")
    n = len(model.centers)
    choice = f"{n - 1}"
    for c in reversed(range(n - 1)):
        cond = " AND ".join(f"d{c} <= d{o}" for o in range(c + 1, n))
        choice = f"CASE WHEN {cond} THEN {c} ELSE {choice} END"
    denom = "(" + "(" * (n - 1) + "exp(-d0)" + "".join(f" + exp(-d{c}))" for c in range(1, n)) + ")"
    chosen = "CASE " + " ".join(f"WHEN cluster = {c} THEN d{c}" for c in range(n)) + " END"
    names = "[" + ", ".join(f"'{x}'" for x in model.names) + "]"
    base = "CASE " + " ".join(f"WHEN seg = '{k}' THEN '{v}'" for k, v in SEGMENT_DESCRIPTIONS.items()) \
           + f" ELSE '{DEFAULT_DESCRIPTION}' END"
    return f"""
SELECT customer_id, cluster, seg AS segment_name, round_even(exp(-({chosen})) / {denom}, 2) AS confidence,
       {base} || ' Fitur dominan: ' || CASE WHEN COALESCE(dominant_feature, '') = '' THEN '{NO_DOMINANT_FEATURE}'
       ELSE dominant_feature END || '. Total aktivitas terdeteksi: ' || CAST(total_activity AS VARCHAR) || '.' AS description
FROM (SELECT *, {names}[cluster + 1] AS seg FROM (
  SELECT *, {choice} AS cluster FROM (
    SELECT *, {', '.join(f'{dist[c]} AS d{c}' for c in range(n))} FROM (
      SELECT *, {', '.join(f'{coords[j]} AS p{j}' for j in range(len(coords)))} FROM {source}) a) b) c) d"""


# Bundled model: parameters of ``train_segments(k=4, pca_k=3, seed=7)`` fitted
# on the sf0.01 model features (silhouette 0.42). The reference loads its
# fitted scaler / PCA / KMeans from files that are not part of it; these play
# that role until a model is trained on production data.
DEFAULT_MODEL = SegmentModel(
    mean=[10.0, 50250000.0, 0.19237306666666668, 0.19400633333333334, 0.19409993333333336,
          0.20025173333333335, 0.8686666666666667, 0.4, 0.4, 0.25, 0.4, 26.5, 8.0, 8456.252,
          1.6893333333333334, 4.0, 2.0],
    std=[3.205232546496132, 0.0, 0.12973414009426953, 0.1275933222539935, 0.13077843433043349,
         0.12884688873809572, 0.33787719103204056, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 237.08865257983442,
         1.6468032252814604, 0.0, 0.0],
    components=[
        [-0.10170157192637283, -0.6427502514202497, 0.020935903824826983],
        [0.0, -1.1102230246251565e-16, 6.591949208711867e-17],
        [-0.3183947216281966, 0.2285692214423553, 0.4799173542866356],
        [0.5141481724525047, -0.13392272772992397, 0.5211262894949094],
        [-0.2084357765297562, 0.057527929109318636, -0.36179462876723717],
        [0.34799708224601594, 0.02343974808096911, -0.6040431792370254],
        [-0.28705261423403594, -0.45042581739386073, 0.002905972388149149],
        [0.0, 0.0, 0.0],
        [0.0, 0.0, 0.0],
        [0.0, 0.0, 0.0],
        [0.0, 0.0, 0.0],
        [0.0, 0.0, 0.0],
        [0.0, 0.0, 0.0],
        [0.03778585560585784, 0.5449597731560168, 0.025432241911636237],
        [-0.6128285501337164, 0.11388359212339089, -0.035350417126994174],
        [0.0, 0.0, 0.0],
        [0.0, 0.0, 0.0],
    ],
    centers=[
        [-0.02497897184369209, 1.5895361710259694, -1.1143458345352264],
        [1.5782050937936336, 0.49300249349182373, 0.9485256160585076],
        [-1.31671966105635, -0.06763563214637001, 0.2737606467419203],
        [0.6278386548289996, -0.9477318858999498, -0.3855605193147748],
    ],
    names=["digital_spender", "bill_payer", "investor", "low_activity"],
)
