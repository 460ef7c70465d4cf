"""Quality classifier: regularised quadratic discriminant over text statistics.

Statistics of every text (shares and logarithms, computed JVM-side) are standardised; each
class has a mean and a covariance, shrunk towards the pooled one and towards its
diagonal. A text's score comes from the difference of the two classes' log densities, each a
Mahalanobis distance by a Cholesky factor computed once and sent with the scoring function.

Training reads sums and sums of products per class: two rows reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import shared_table
from tessera.llm.text_stats import base_stats, more_stats

FEATURES = ("mean_length", "symbols", "upper", "shouts", "digits", "points", "variety", "repeats", "lines", "line_words")


def features() -> list[Column]:
    """Transformed statistics from the structs ``b`` and ``m`` of a text; an empty text has all zeros."""
    b, m = F.col("b"), F.col("m")
    n = F.greatest(b["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(b["word_chars"], F.lit(1)).cast("double")
    out = {
        "mean_length": F.log1p(b["word_chars"] / n),
        "symbols": F.log1p(10 * b["n_symbols"] / n),
        "upper": F.sqrt(m["n_upper"] / chars),
        "shouts": F.log1p(10 * m["n_shouts"] / n),
        "digits": F.sqrt(m["n_digits"] / chars),
        "points": F.sqrt(m["n_points"] / n),
        # texts use new words at a falling rate, so the logarithms are compared
        "variety": F.when(b["n_words"] > 1, F.log(m["n_distinct"].cast("double")) / F.log(n)).otherwise(F.lit(1.0)),
        "repeats": F.sqrt(b["n_repeat_words"] / n),
        "lines": F.sqrt(b["n_dup_lines"] / m["n_lines"]),
        "line_words": F.log1p(n / m["n_lines"]),
    }
    return [F.when(b["n_words"] > 0, out[f]).otherwise(0.0).alias(f) for f in FEATURES]


@dataclass
class Model:
    """Standardisation, and per class (0, 1): count, mean, Cholesky factor, half log determinant."""

    center: list
    scale: list
    classes: dict

    def scores(self, x):
        """Scores of the rows of ``x``; the prior when a class has no labelled row."""
        import numpy as np

        n = {k: c[0] for k, c in self.classes.items()}
        if len(n) < 2:
            return np.full(len(x), 0.5 if not n else float(next(iter(n))))
        z = (x - np.array(self.center)) / np.array(self.scale)
        log_density = {}
        for k, (count, mean, factor, half_log_det) in self.classes.items():
            away = np.linalg.solve(np.array(factor), (z - np.array(mean)).T)
            log_density[k] = np.log(count) - half_log_det - 0.5 * (away * away).sum(0)
        # the mean difference per statistic keeps far texts apart instead of rounding them to 0 or 1
        d = np.clip((log_density[1] - log_density[0]) / x.shape[1], -30, 30)
        return 1 / (1 + np.exp(-d))


def fit(labelled: DataFrame, label: str = "label", to_pooled: float = 0.5, to_diagonal: float = 0.2) -> Model:
    """``labelled``: the columns FEATURES and a 0/1 label; rows with another or no label are left out."""
    import numpy as np

    data = labelled.filter(F.col(label).isin(0, 1))
    d = len(FEATURES)
    row = data.agg(*[F.avg(f).alias(f"a_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).first()
    center = [row[f"a_{f}"] or 0.0 for f in FEATURES]
    scale = [row[f"s_{f}"] or 1.0 for f in FEATURES]
    z = data.select(label, *[((F.col(f) - c) / s).alias(f) for f, c, s in zip(FEATURES, center, scale, strict=True)])
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = z.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"x{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    moments = {}
    for r in rows:
        mean = np.array([r[f"x{i}"] for i in range(d)]) / r["n"]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        moments[int(r[label])] = (r["n"], mean, second - np.outer(mean, mean))
    total = sum(n for n, _, _ in moments.values())
    classes = {}
    if moments:
        pooled = sum(n * s for n, _, s in moments.values()) / total
        for k, (n, mean, cov) in moments.items():
            # the fewer rows, the more of the pooled covariance
            share = max(to_pooled, d / (n + d))
            cov = (1 - share) * cov + share * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 0.01 * np.eye(d)
            factor = np.linalg.cholesky(cov)
            classes[k] = (n, mean.tolist(), factor.tolist(), float(np.log(np.diag(factor)).sum()))
    return Model(center, scale, classes)


def score(stats: DataFrame, model: Model, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score of every row of ``stats`` (doc_id and FEATURES)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]) if b.num_rows else \
                np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(doc_id), pa.array(model.scores(x))], names=[doc_id, "score"])

    schema = T.StructType([stats.schema[doc_id], T.StructField("score", T.DoubleType())])
    return stats.select(doc_id, *FEATURES).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and FEATURES of every row."""
    s = docs.select(doc_id, base_stats(F.col(text)).alias("b"), more_stats(F.col(text)).alias("m"))
    return s.select(doc_id, *features())


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row.

    Learns from labelled rows that are not held out; language, source and id are
    no inputs. Null and empty texts have all statistics zero and get a score like any other;
    with labels of one class only, that class is the score, without any 0.5;
    repeated rows (and labels) count as often as they occur; an empty table gives no rows.
    """
    stats = shared_table(statistics(docs, doc_id, text), "statistics")
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isNotNull() & ~held_out(F.col("__id")))
    model = fit(stats.join(known, stats[doc_id] == known["__id"]))
    out = score(stats, model, doc_id)
    return out.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
