"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees propose rules: every path from a root is a conjunction of bounds on statistics. A lasso logistic
regression over all rules keeps few of them. What is left is compiled into a Spark column expression, so documents are
scored inside the plan that computes the statistics, without Python.

Null and empty texts have the statistics of a text without words and get a score as any other. If the labelled rows
hold one class only, every score is that class's share; without labelled rows it is 0.5. Labels that are null or not
0 or 1 are not used; a document with several labels counts once for each. Repeated rows are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import free_name

#: Most labelled rows that the classifier is fitted on, as an expected number; which ones depends on the id alone.
SAMPLE_ROWS = 20_000

Bound = tuple[int, bool, float]  # statistic, above?, threshold
Rule = tuple[Bound, ...]


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float


def statistics(text: Column) -> dict[str, Column]:
    """Statistics over a whole text; all are defined for null and empty texts."""
    text = F.coalesce(text, F.lit(""))
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.filter(F.split(squeezed, " "), lambda w: w != "")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    n_words = F.size(words)
    per_word = F.greatest(n_words, F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": F.length(squeezed) / per_word,
        "upper": share(r"\p{Lu}"),
        "letters": share(r"\p{L}"),
        "digits": share(r"[0-9]"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'\"!?()-]"),
        "shouts": share(r"[!?]"),
        "stops": share(r"[.]"),
        "commas": share(r"[,;]"),
        "different_words": F.size(F.array_distinct(words)) / per_word,
        "repeats_before": F.regexp_count(text, F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")) / per_word,
        "one_letter_words": F.regexp_count(text, F.lit(r"(?<!\S)\S(?!\S)")) / per_word,
        "different_lines": F.size(F.array_distinct(lines)) / n_lines,
        "words_per_line": n_words / n_lines,
    }


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` and an array of the statistics, in the order of ``statistics``."""
    columns = statistics(F.col(f"`{text_col}`"))
    return docs.withColumn(name, F.array(*[c.cast("double") for c in columns.values()]))


# Rules


def _grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int) -> list[tuple]:
    """Rows of a regression tree on binned statistics: (path of (statistic, above, bin), value) per node but the root."""
    width = int(bins.max()) + 1
    found: list[tuple] = []

    def split(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = gradient[rows], hessian[rows]
        if path:
            found.append((path, rows, g.sum() / (h.sum() + 1.0)))
        if not left or len(rows) < 2 * least:
            return
        best, cut = 1e-6, None
        for k in range(bins.shape[1]):
            b = bins[rows, k]
            n = np.cumsum(np.bincount(b, minlength=width))[:-1]
            gs = np.cumsum(np.bincount(b, g, width))[:-1]
            hs = np.cumsum(np.bincount(b, h, width))[:-1]
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best:
                best, cut = gain[at], (k, at)
        if cut is None:
            return
        k, at = cut
        above = bins[rows, k] > at
        split(rows[~above], (*path, (k, False, at)), left - 1)
        split(rows[above], (*path, (k, True, at)), left - 1)

    split(np.arange(len(bins)), (), depth)
    return found


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """The distinct paths of boosted trees, as rules."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])) for k in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    least = max(5, len(y) // 500)
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        nodes = _grow(bins, y - chance, chance * (1 - chance), depth, least)
        longest: dict[tuple, tuple] = {path: (rows, value) for path, rows, value in nodes}
        for path, (rows, value) in longest.items():
            if not any(other[: len(path)] == path and len(other) > len(path) for other in longest):
                margin[rows] += rate * value
            rules[tuple((k, above, float(edges[k][at])) for k, above, at in path)] = None
    return list(rules)


def rule_matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    columns = [
        np.all([(x[:, k] > t) if above else (x[:, k] <= t) for k, above, t in rule], axis=0).astype(float)
        for rule in rules
    ]
    return np.column_stack(columns) if columns else np.zeros((len(x), 0))


def lasso_logistic(
    x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-penalised logistic regression, by accelerated proximal steps."""
    weights, intercept, n = np.zeros(x.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), len(y)
    wide = np.column_stack([x, np.ones(n)])
    reach = wide.T @ (wide / n)
    vector = np.ones(reach.shape[0])
    for _ in range(30):
        vector = reach @ vector
        vector /= np.linalg.norm(vector)
    step = 1 / (0.25 * float(vector @ reach @ vector) * 1.05)
    now = ahead = np.append(weights, intercept)
    pace = 1.0
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-(wide @ ahead)))
        moved = ahead - step * (wide.T @ (chance - y) / n)
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, now, pace = moved + (pace - 1) / faster * (moved - now), moved, faster
    return now[:-1], float(now[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4, trees: int = 30, depth: int = 3) -> RuleModel:
    if len(y) == 0:
        return RuleModel((), (), 0.0)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    if y.min() == y.max():
        return RuleModel((), (), float(np.log(share / (1 - share))))
    rules = tree_rules(x, y, trees, depth)
    weights, intercept = lasso_logistic(rule_matrix(rules, x), y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-4)
    return RuleModel(tuple(rules[k] for k in kept), tuple(float(weights[k]) for k in kept), intercept)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> RuleModel:
    """A model of the labelled rows, or of about ``sample_rows`` of them chosen by a hash of the id if there are more.

    The driver gets the statistics of the sample only: at most about ``sample_rows`` x 14 numbers.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    every = max(1, -(-marks.count() // sample_rows))
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # The statistics are behind the join: only labelled texts are looked at. The sample is bounded, so it is broadcast.
    joined = with_statistics(texts.join(F.broadcast(marks), "id")).select("id", "label", "stats").toPandas()
    joined = joined.sort_values(["id", "label"], kind="stable")
    x = np.array(joined["stats"].tolist(), float).reshape(len(joined), len(statistics(F.lit(""))))
    return fit_rules(x, joined["label"].to_numpy(float))


def score_column(model: RuleModel, stats: Column) -> Column:
    """The model as a column over the array of statistics; rules share their bounds."""
    total = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        held = None
        for k, above, threshold in rule:
            bound = (stats[k] > threshold) if above else (stats[k] <= threshold)
            held = bound if held is None else held & bound
        total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and its score between 0 and 1."""
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name} already: choose another name")
    stats = free_name([*docs.columns, name], "_statistics_of_text")
    # The rules read the array often; a struct in an array that is exploded is computed once.
    rows = with_statistics(docs, text_col, stats).withColumn(stats, F.explode(F.array(stats)))
    return rows.withColumn(name, score_column(model, F.col(stats))).drop(stats)


def held_out_quality(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """Scores of all documents; labels of those whose crc32 of the id leaves ``held`` take no part."""
    held_out = lambda: F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == held
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
