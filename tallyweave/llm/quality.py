"""Operator 11, document quality by a regularised quadratic discriminant.

measured() turns every whole text into a few statistics, each transformed so
that it is near normal (logarithms of sizes, square roots of shares), with
DataFrame functions only. fitted() takes counts, means and second moments of
both classes over all labelled rows that are not held out, in one aggregation
with a row a class. Each class covariance is shrunk towards the diagonal of the
pooled one, as if PRIOR_ROWS rows of that had been seen besides; its Cholesky
factor, inverted once, is the model. The score is logistic in the difference of
the two Mahalanobis log-densities, plus the logarithm of the classes' odds; it is
a plain expression over the statistics.

Texts are read once: the statistics are written as a narrow table, and both
fitting and scoring read that. Nothing but two rows of sums reaches the driver.

Null and empty texts have the statistics of a text without words and get that
score. Labels that are null, and labels of documents that are not there, are not
used; a document labelled twice is good if one label says so. Without labels of
both kinds the score is the share of label 1, (n1 + 1) / (n + 2). Repeated rows
give repeated rows and count as often as they stand; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_SQL, CRC32_TABLE, checkpointed, held_out, table

#: Rows of the pooled diagonal covariance that each class is taken to hold besides its own, and the least variance of a statistic.
PRIOR_ROWS, LEAST = 100, 1e-4
#: From where on a document counts as good.
GOOD = 0.3
#: The query tells scores to so many places.
PLACES = 6

_SPACE, _ODD, _UPPER = "[ \\t\\n\\r\\f]+", r"[^\p{L}\p{N} \t\n\r\f.,]", r"\p{Lu}"
#: The statistics, as SQL over the numbers that counted() makes; the constants keep short texts from extremes.
STATISTICS = {
    "size": "ln(1 + n_words)",
    "length": "ln((10 + n_inside) / (2 + n_words))",
    "upper": "sqrt(n_upper / (50 + n_inside))",
    "odd": "sqrt(n_odd / (50 + n_inside))",
    "again": "sqrt(n_again / (10 + n_words))",
    "kinds": "ln((10 + n_kinds) / (10 + n_words))",
    "pairs": "ln((20 + n_pairs) / (20 + n_words))",
    "lines": "ln((10 + n_words) / (1 + n_lines))",
}
NAMES = tuple(STATISTICS)


def counted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the numbers of a text: words, characters inside words, capitals, odd signs, words like the one before, different words and pairs, lines."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    out = docs.withColumn("_h", hashed).withColumn("_n", F.size("_h"))
    later = F.slice("_h", F.lit(2), F.greatest(F.col("_n") - 1, F.lit(0)))
    out = out.withColumn("_p", F.slice(F.zip_with("_h", later, lambda a, b: F.struct((a == b).alias("same"), F.xxhash64(a, b).alias("pair"))), F.lit(1), F.greatest(F.col("_n") - 1, F.lit(0))))
    held = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return out.withColumns({
        "n_words": F.col("_n"), "n_inside": F.length(F.regexp_replace(text, _SPACE, "")), "n_upper": held(_UPPER), "n_odd": held(_ODD), "n_again": F.size(F.filter("_p", lambda p: p["same"])),
        "n_kinds": F.size(F.array_distinct("_h")), "n_pairs": F.size(F.array_distinct(F.transform("_p", lambda p: p["pair"]))), "n_lines": F.regexp_count(text, F.lit("\n")) + 1,
    }).drop("_h", "_n", "_p")


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the statistics of every row of docs."""
    rows = counted(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    return rows.select("doc_id", *(F.expr(e).alias(n) for n, e in STATISTICS.items()))


@dataclass(frozen=True)
class Density:
    """A class: its share of the labelled rows, its means, and the inverse of the Cholesky factor of its shrunk covariance."""

    share: float
    mean: np.ndarray
    factor: np.ndarray

    def log(self) -> Column:
        """The logarithm of share and density at a row's statistics, without what both classes have in common."""
        out = F.lit(float(np.log(self.share) + np.log(np.diag(self.factor)).sum()))
        for row in range(len(NAMES)):
            z = sum((F.lit(float(self.factor[row, k])) * (F.col(NAMES[k]) - F.lit(float(self.mean[k]))) for k in range(row + 1)), F.lit(0.0))
            out = out - z * z / 2
        return out


@dataclass(frozen=True)
class Model:
    """The densities of labels 0 and 1; without both, the score of every document."""

    bad: Density | None
    good: Density | None
    constant: float = 0.5

    def score(self) -> Column:
        if self.bad is None or self.good is None:
            return F.lit(self.constant)
        return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), self.bad.log() - self.good.log()))))


def fitted(rows: DataFrame, labels: DataFrame, prior_rows: float = PRIOR_ROWS) -> Model:
    """The discriminant of the rows of measured() whose labels (doc_id, quality) are not held out."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("_good"))
    # Written first, so that a join with many rows of one id may be split.
    both = rows.join(checkpointed(usable), "doc_id")
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
    sums = both.groupBy("_good").agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m_{a}") for a in NAMES), *(F.covar_pop(a, b).alias(f"v_{a}_{b}") for a, b in pairs))
    seen = {r["_good"]: r for r in sums.where("_good IN (0, 1)").collect()}
    n = {k: seen[k]["n"] if k in seen else 0 for k in (0, 1)}
    if not all(n.values()):
        return Model(None, None, (n[1] + 1) / (n[0] + n[1] + 2))
    spread = np.maximum(sum(n[k] * np.array([seen[k][f"v_{a}_{a}"] for a in NAMES]) for k in n) / sum(n.values()), LEAST)

    def density(k: int) -> Density:
        own = np.zeros((len(NAMES), len(NAMES)))
        for i, a in enumerate(NAMES):
            for j, b in enumerate(NAMES[: i + 1]):
                own[i, j] = own[j, i] = seen[k][f"v_{a}_{b}"]
        shrunk = (n[k] * own + prior_rows * np.diag(spread)) / (n[k] + prior_rows)
        return Density(n[k] / sum(n.values()), np.array([seen[k][f"m_{a}"] for a in NAMES]), np.linalg.inv(np.linalg.cholesky(shrunk)))

    return Model(density(0), density(1))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows of measured() with score."""
    return rows.withColumn("score", model.score())


def good_only(docs: DataFrame, labels: DataFrame, threshold: float = GOOD) -> DataFrame:
    """The rows of docs (doc_id, text) that score at least the threshold, with all their columns; any other names may stand."""
    ids, texts = docs.columns.index("doc_id"), docs.columns.index("text")
    model = fitted(checkpointed(measured(docs)), labels)
    mine = [f"c{k}" for k in range(len(docs.columns))]
    rows = counted(docs.toDF(*mine).withColumn("_text", F.col(mine[texts])).withColumn("_id", F.col(mine[ids])), "_text")
    kept = rows.withColumns({n: F.expr(e) for n, e in STATISTICS.items()}).where(model.score() >= threshold)
    return kept.select(*(F.col(a).alias(b) for a, b in zip(mine, docs.columns, strict=True)))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(measured(table(spark, sf_dir, "documents")))
    found = scored(rows, fitted(rows, table(spark, sf_dir, "labels"))).withColumn("score", F.round("score", PLACES))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def _oracle() -> str:
    """The same in DuckDB's SQL: the factor of each class is worked out a column at a time, and each document's z by forward substitution."""
    k = range(len(NAMES))
    steps = []
    for j in k:
        before = "s" if j == 0 else f"l{j - 1}"
        less = lambda i, j=j: "".join(f" - l_{i}_{m} * l_{j}_{m}" for m in range(j))
        steps.append(f"h{j} AS (SELECT *, sqrt(s_{j}_{j}{less(j)}) AS l_{j}_{j} FROM {before})")
        steps.append(f"l{j} AS (SELECT *" + "".join(f", (s_{i}_{j}{less(i)}) / l_{j}_{j} AS l_{i}_{j}" for i in k if i > j) + f" FROM h{j})")
    forward = ["z0 AS (SELECT x.r, l.*, " + ", ".join(f"x.{n} - m_{i} AS c_{i}" for i, n in enumerate(NAMES)) + f", (x.size - m_0) / l_0_0 AS z_0 FROM x CROSS JOIN l{k[-1]} AS l)"]
    for j in k[1:]:
        forward.append(f"z{j} AS (SELECT *, (c_{j}" + "".join(f" - l_{j}_{m} * z_{m}" for m in range(j)) + f") / l_{j}_{j} AS z_{j} FROM z{j - 1})")
    density = "ln(n / total)" + "".join(f" - ln(l_{j}_{j}) - z_{j} * z_{j} / 2" for j in k)
    held = f"{CRC32_SQL.format('CAST(doc_id AS VARCHAR)')} % 5 = 0"
    return f"""WITH crc AS ({CRC32_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce({held}, false) AS held_out FROM documents, crc),
w AS (SELECT *, list_filter(string_split_regex(t, '{_SPACE}'), lambda w: w <> '') AS ws FROM d),
counted AS (SELECT r, doc_id, held_out, len(ws) AS n_words, len(regexp_replace(t, '{_SPACE}', '', 'g')) AS n_inside, len(t) - len(regexp_replace(t, '{_UPPER}', '', 'g')) AS n_upper,
  len(t) - len(regexp_replace(t, '{_ODD}', '', 'g')) AS n_odd, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_again, len(list_distinct(ws)) AS n_kinds,
  len(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS n_pairs, len(t) - len(replace(t, chr(10), '')) + 1 AS n_lines FROM w),
x AS (SELECT r, doc_id, held_out, {', '.join(f'{e} AS {n}' for n, e in STATISTICS.items())} FROM counted),
lab AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT q, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'avg({n}) AS m_{i}' for i, n in enumerate(NAMES))}, {', '.join(f'covar_pop({NAMES[i]}, {NAMES[j]}) AS v_{i}_{j}' for i in k for j in k if j <= i)}
  FROM x JOIN lab USING (doc_id) WHERE NOT held_out AND q IN (0, 1) GROUP BY q),
p AS (SELECT sum(n) AS total, {', '.join(f'greatest(sum(n * v_{i}_{i}) / sum(n), {LEAST}) AS p_{i}' for i in k)} FROM c),
s AS (SELECT q, n, total, {', '.join(f'm_{i}' for i in k)}, {', '.join(f'(n * v_{i}_{j}' + (f' + {PRIOR_ROWS} * p_{i}' if i == j else '') + f') / (n + {PRIOR_ROWS}) AS s_{i}_{j}' for i in k for j in k if j <= i)} FROM c, p),
{', '.join(steps)},
{', '.join(forward)},
told AS (SELECT r, max({density}) FILTER (q = 1) AS good, max({density}) FILTER (q = 0) AS bad FROM z{k[-1]} GROUP BY r),
score AS (SELECT r, round(1 / (1 + exp(greatest(-700, least(700, bad - good)))), {PLACES}) AS score FROM told)
SELECT doc_id, held_out, score, CASE WHEN score >= {GOOD} THEN 1 ELSE 0 END AS predicted FROM d JOIN score USING (r)"""


ORACLE = _oracle()
