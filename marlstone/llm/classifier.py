"""Document quality by regularised quadratic discriminant analysis.

Statistics of a text are transformed to near-normal features. Each class has a mean and a covariance, shrunk
toward the pooled covariance and then toward its own average variance. A document's score is the logistic of
the difference of log densities: Mahalanobis distances from Cholesky factors that are computed once.

The fit needs sums and products over the labelled rows only; these are one aggregate over all of them. No
label, language, source or id is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches, words, written
from marlstone.llm.quality import OTHER, Rules, common_words, letters

#: Shrinkage toward the pooled covariance, and toward a multiple of the identity.
POOLED, ROUND = 0.1, 0.01
FEATURES = ["words", "length", "upper", "symbols", "cries", "marks", "digits", "spaces", "distinct", "again", "common", "long_line"]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one double for each of ``FEATURES``; null and empty texts give zeros.

    Common words are learned from the texts: those that make up a five-hundredth of all or more.
    """
    common = common_words(docs.select(text_col), text_col, "", Rules(common_of=500))[OTHER]
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    d = d.withColumns({"w": words(F.col("t")), "rest": F.regexp_replace("t", r"\p{L}+", "")})
    d = d.withColumns({
        "n": F.size("w"),
        "c": F.length("t"),
        "upper": F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")),
        "other": F.size(F.array_distinct("w")),
        "same": F.size(F.filter(F.zip_with("w", F.expr("slice(w, 2, size(w))"), lambda a, b: a == b), lambda x: x)),
        "letters": letters(F.col("t")),
        "line": F.array_max(F.transform(F.split("t", "\n"), lambda x: F.length(x))),
    })

    d = d.withColumns({"frequent": F.size(F.filter("letters", lambda x: x.isin(list(common) or [""]))), "runs": F.size("letters")})

    def kept(chars: str) -> Column:
        return F.length("rest") - F.length(F.regexp_replace("rest", f"[{chars}]+", ""))

    def share(count: Column | str, of: str) -> Column:
        """The angle of a share: its variance hardly depends on its size."""
        x = F.col(count) if isinstance(count, str) else count
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(x.cast("double"), F.col(of)), F.lit(0.0))))))

    made = {
        "words": F.log1p(F.col("n").cast("double")),
        "length": F.log1p(F.coalesce(F.try_divide(F.col("c").cast("double"), F.col("n")), F.lit(0.0))),
        "upper": share("upper", "c"),
        "symbols": share(kept(r"#*$%&|<>=_~^{}\[\]+@/\\"), "c"),
        "cries": share(kept("!?"), "c"),
        "marks": share(kept(r".,;:'\"()\-"), "c"),
        "digits": share(kept("0-9"), "c"),
        "spaces": share(kept(r"\x20\x09-\x0D"), "c"),
        "distinct": share("other", "n"),
        "again": share("same", "n"),
        "common": share("frequent", "runs"),
        "long_line": F.log1p(F.coalesce(F.col("line"), F.lit(0)).cast("double")),
    }
    return d.select("doc_id", *(made[f].alias(f) for f in FEATURES))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of two classes."""

    prior: float
    means: np.ndarray
    factors: np.ndarray
    dets: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, round_: float = ROUND) -> Discriminant | None:
        """From counts (2), sums (2, d) and products (2, d, d); None where a class has fewer than two rows."""
        if min(counts) < 2:
            return None
        means = sums / counts[:, None]
        own = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
        both = (own * counts[:, None, None]).sum(0) / counts.sum()
        d = sums.shape[1]
        factors, dets = [], []
        for s in own:
            s = (1 - pooled) * s + pooled * both
            s = (1 - round_) * s + round_ * max(np.trace(s) / d, 1e-9) * np.eye(d)
            low = np.linalg.cholesky((s + s.T) / 2)
            factors.append(np.linalg.inv(low))
            dets.append(2 * np.log(np.diag(low)).sum())
        return cls(float(np.log(counts[1] / counts[0])), means, np.array(factors), np.array(dets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of features."""
        far = [(((x - m) @ f.T) ** 2).sum(1) for m, f in zip(self.means, self.factors, strict=True)]
        logit = self.prior + (far[0] - far[1] + self.dets[0] - self.dets[1]) / 2
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def fit(table: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[Discriminant | None, float]:
    """The discriminant over the rows that are not held out, and the share of class 1 among them."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = table.where("not held_out").join(known, "doc_id")
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    crossed = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    d = len(FEATURES)
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows.groupBy("y").agg(F.count("*").alias("n"), *sums, *crossed).collect():  # two rows
        n[r["y"]] = r["n"]
        s[r["y"]] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            p[r["y"], i, j] = p[r["y"], j, i] = r[f"p{i}_{j}"]
    return Discriminant.fit(n, s, p), float(n[1] / n.sum()) if n.sum() else 0.5


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (0 or 1).

    Rows whose crc32 of the id as text leaves 1 modulo 3 are held out; labels are read for the others only.
    Repeated labels of one id count once, by majority; null labels and ids are not learned from. A row without
    an id is scored and not held out. With fewer than two rows of a class every score is the share of class 1
    (a half without labels). A label tied between its classes counts as class 1, a score of a half as class 1.
    Texts of any length are read whole. Repeated rows are scored alike; an empty table gives no rows. Other columns
    are not read, whatever their names.
    """
    small_batches(docs.sparkSession, 5000)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    table = written(features(docs, id_col, text_col).withColumn("held_out", held), "features")
    model, share = fit(table, labels, id_col, label_col)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[FEATURES].to_numpy(float)
            y = model.score(x) if model else np.full(len(b), share)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": y, "predicted": (y >= 0.5).astype(np.int32)})

    return table.mapInPandas(score, "doc_id bigint, held_out boolean, score double, predicted int")
