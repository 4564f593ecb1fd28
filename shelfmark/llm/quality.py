"""Quality classifier: a document model's evidence combined with posteriors of its host and path (empirical Bayes)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import small, written

#: Labelled rows that the document model is fitted on at most, those of the lowest hash; all else covers all rows.
MAX_TRAIN = 20_000
FEATURES = ("length", "upper", "symbols", "digits", "variety", "distinct", "word_length")


def features(text: Column) -> dict[str, Column]:
    """What the document model sees of a whole text; zeros for null and empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0)
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    return {
        "length": F.log1p(n),
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")) / chars,
        "symbols": F.regexp_count(t, F.lit(r"[^\p{L}\p{M}\p{N}\s.,]")) / chars,
        "digits": F.regexp_count(t, F.lit(r"\p{N}")) / chars,
        "variety": F.when(n > 1, F.log1p(kinds) / F.log1p(n)).otherwise(0.0),
        "distinct": F.when(n > 0, kinds / n).otherwise(0.0),
        "word_length": F.when(n > 0, F.log1p(chars / n)).otherwise(0.0),
    }


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression by Newton's method. One class or no rows: the smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _strength(groups: DataFrame, n: str, s: str, prior: Column) -> float:
    """How many rows a prior is worth: from the spread of the groups' rates round it beyond what their sizes explain."""
    rate = F.col(s) / F.col(n)
    many = groups.where(F.col(n) >= 2)
    noise = F.sum(prior * (1 - prior))
    spread = F.sum(F.col(n) * (rate - prior) ** 2)
    r = many.agg(spread.alias("a"), noise.alias("b"), F.sum(n).alias("n"), F.avg(prior * (1 - prior)).alias("v")).first()
    if not r["n"] or r["v"] is None:
        return 10.0
    between = max(1e-6, (r["a"] - r["b"]) / r["n"])
    return float(min(1e4, max(1.0, r["v"] / between - 1)))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, max_train: int = MAX_TRAIN, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, doc_score, host_rate, path_rate, score, keep for every row of docs.

    doc_score is the document model's probability of good quality; a labelled row counts as its label in its site's
    evidence, any other as its doc_score. A host's rate is drawn towards the global one and a path's towards its
    host's, the sparser the more; how much follows from the spread between groups. A row's own evidence is left out of
    its rates. score shifts the row's log odds by those of its path against the global rate.

    Null texts count as empty, null hosts and paths as groups of their own; rows are kept apart even if ids repeat (all
    of them then take the label). Labels that are null are ignored, contradicting ones for one id are averaged. Without
    usable labels all rows score alike. host and path default to source and lang. Columns in `carry` go along.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    own = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    made = features(F.col("text"))
    seen = written(docs.select("doc_id", *carry, own(host).alias("host"), own(path).alias("path"), *(v.cast("double").alias(k) for k, v in made.items())), "features")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    seen = written(seen.join(known, "doc_id", "left"), "labelled")
    # a share by hash first, so that no task sends the driver much more than its part of the sample
    usable = seen.where("y in (0, 1)")
    share = min(1.0, 1.5 * max_train / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select("y", *FEATURES).toPandas()
    weights, intercept = fit(sample[list(FEATURES)].to_numpy(dtype=float), sample["y"].to_numpy(dtype=float))
    logit = sum((F.col(k) * float(w) for k, w in zip(FEATURES, weights, strict=True)), F.lit(intercept))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    rows = seen.select("doc_id", *carry, "host", "path", p.alias("doc_score"), F.coalesce("y", p).alias("e"))
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("pn"), F.sum("e").alias("ps")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs")), "hosts")
    n, s = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    mu = (s + 1) / (n + 2) if n else 0.5
    k_host = _strength(hosts, "hn", "hs", F.lit(mu))
    sites = paths.join(small(hosts), "host")
    k_path = _strength(sites, "pn", "ps", (F.col("hs") + k_host * mu) / (F.col("hn") + k_host))
    sites = small(written(sites, "sites"))
    at = rows.join(sites, ["host", "path"])
    host_rate = (F.greatest(F.lit(0.0), F.col("hs") - F.col("e")) + k_host * mu) / (F.col("hn") - 1 + k_host)
    path_rate = (F.greatest(F.lit(0.0), F.col("ps") - F.col("e")) + k_path * F.col("host_rate")) / (F.col("pn") - 1 + k_path)
    score = 1 / (1 + F.exp(-(_logit(F.col("doc_score")) + _logit(F.col("path_rate")) - float(np.log(mu / (1 - mu))))))
    out = at.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate).withColumn("score", score)
    return out.select("doc_id", *carry, "doc_score", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep"))


__all__ = ["MAX_TRAIN", "classify", "features", "fit"]
