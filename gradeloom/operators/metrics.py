"""Scores of class predictions, from one pass over the rows.

Every function first reduces the rows to counts per (group, class, predicted class), which Spark
aggregates map-side, and works on those few rows afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.probability import argmax, log_loss_term, log_sum_exp
from gradeloom.functions.text import array, name, number, pick, slots, text, total
from gradeloom.operators.ranking import running_sums


def confusion_counts(
    df: DataFrame, by: tuple[str, ...] = (), y: str = "y", y_pred: str = "y_pred"
) -> DataFrame:
    """``(by, y, y_pred, n)`` for the pairs that occur."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(y_pred).alias("y_pred")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(counts: DataFrame, labels: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Counts for every pair of ``labels``, zeros included."""
    pairs = ", ".join(f"struct({a} AS y, {b} AS y_pred)" for a in labels for b in labels)
    key = "struct(cast(y AS int) AS y, cast(y_pred AS int) AS y_pred)"
    return (
        counts.groupBy(*by)
        .agg(F.expr(f"map_from_entries(collect_list(struct({key}, n))) AS _n"))
        .select(*by, "_n", F.expr(f"explode(array({pairs})) AS _pair"))
        .select(*by, "_pair.y", "_pair.y_pred", F.expr("coalesce(try_element_at(_n, _pair), 0L) AS n"))
    )


def class_counts(counts: DataFrame, by: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """Per label true positives ``tp``, ``support`` and ``predicted``; ``sums`` go to the true label."""
    own = "".join(f", {s}" for s in sums)
    none = "".join(f", 0.0D AS {s}" for s in sums)
    as_true = f"struct(y AS label, if(y = y_pred, n, 0L) AS tp, n AS support, 0L AS predicted{own})"
    as_predicted = f"struct(y_pred AS label, 0L AS tp, 0L AS support, n AS predicted{none})"
    return (
        counts.select(*by, F.expr(f"inline(array({as_true}, {as_predicted}))"))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted", *sums)])
    )


def f_beta(beta: float = 1.0) -> str:
    """F-beta of a row of :func:`class_counts`; 0 where it is undefined."""
    b2 = beta * beta
    both = f"support * {number(b2)} + predicted"
    return f"coalesce(try_divide(tp * {number(1.0 + b2)}, {both}), 0.0D)"


def _share(hits: str, of: str) -> str:
    return f"coalesce(try_divide(cast({hits} AS double), {of}), 0.0D)"


def class_scores(counts: DataFrame, by: tuple[str, ...] = (), beta: float = 1.0) -> DataFrame:
    """Precision, recall, F-beta and support per label that is true or predicted somewhere."""
    return class_counts(counts, by).selectExpr(
        *by,
        "label",
        f"{_share('tp', 'predicted')} AS precision",
        f"{_share('tp', 'support')} AS recall",
        f"{f_beta(beta)} AS f_score",
        "support",
    )


def class_accuracy(counts: DataFrame, by: tuple[str, ...] = (), empty: str = "zero") -> DataFrame:
    """Share of each true class that is predicted right; ``empty`` classes give ``zero`` or ``skip``."""
    rows = class_counts(counts, by).selectExpr(
        *by, "label", f"{_share('tp', 'support')} AS accuracy", "support"
    )
    return rows.filter("support > 0") if empty == "skip" else rows


def classification_report(
    counts: DataFrame, by: tuple[str, ...] = (), names: tuple[str, ...] = ()
) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg`` and ``weighted avg``.

    ``names`` are shown instead of the class numbers.
    """
    shown = "cast(label AS string)"
    if names:
        shown = f"coalesce(try_element_at({array(text(n) for n in names)}, label + 1), {shown})"
    stats = class_counts(counts, by).selectExpr(
        *by,
        f"{shown} AS label",
        "tp",
        "support",
        f"{_share('tp', 'predicted')} AS precision",
        f"{_share('tp', 'support')} AS recall",
        f"{f_beta()} AS f1",
    )
    scores = ("precision", "recall", "f1")
    both = stats.groupingSets([[*by, "label"], [*by]], *by, "label").agg(
        F.grouping("label").alias("_all"),
        F.sum("support").alias("_support"),
        F.sum("tp").alias("_tp"),
        *[F.expr(f"avg({s}) AS _m_{s}") for s in scores],
        *[F.expr(f"sum({s} * support) AS _w_{s}") for s in scores],
    )

    def row(label: str, values: list[str]) -> str:
        named = ", ".join(f"cast({v} AS double) AS {s}" for v, s in zip(values, scores))
        return f"struct({label} AS label, {named}, _support AS support)"

    macro = [f"_m_{s}" for s in scores]
    weighted = [f"try_divide(_w_{s}, _support)" for s in scores]
    summary = [
        row("'accuracy'", ["NULL", "NULL", "try_divide(_tp, _support)"]),
        row("'macro avg'", macro),
        row("'weighted avg'", weighted),
    ]
    rows = f"if(_all = 0, {array([row('label', macro)])}, {array(summary)})"
    return both.select(*by, F.expr(f"inline({rows})"))


def macro_f_score(counts: DataFrame, by: tuple[str, ...] = (), beta: float = 2.0) -> DataFrame:
    """Mean F-beta of the labels that are true or predicted somewhere, per group."""
    return class_scores(counts, by, beta).groupBy(*by).agg(F.avg("f_score").alias("f_macro"))


def summary_scores(counts: DataFrame, by: tuple[str, ...] = (), loss: str | None = None) -> DataFrame:
    """Accuracy, macro and weighted F1 per group, and the mean of a summed ``loss`` column of ``counts``."""
    per_class = class_counts(counts, by, (loss,) if loss else ()).selectExpr("*", f"{f_beta()} AS _f")
    return per_class.groupBy(*by).agg(
        F.expr("sum(support) AS n"),
        F.expr("sum(tp) / sum(support) AS accuracy"),
        F.expr("avg(_f) AS f1_macro"),
        F.expr("sum(_f * support) / sum(support) AS f1_weighted"),
        *([F.expr(f"sum({loss}) / sum(support) AS log_loss")] if loss else []),
    )


def model_report(
    pred: DataFrame, n_classes: int, by: tuple[str, ...] = ("model",), y: str = "y", probs: str = "probs"
) -> DataFrame:
    """Accuracy, macro F1, weighted F1 and log loss per model, in one pass over a prediction table."""
    counts = (
        pred.selectExpr(
            *by,
            f"{name(y)} AS y",
            f"{argmax(name(probs))} AS y_pred",
            f"{log_loss_term(name(probs), name(y), n_classes)} AS _loss",
        )
        .groupBy(*by, "y", "y_pred")
        .agg(F.count("*").alias("n"), F.sum("_loss").alias("_loss"))
    )
    return summary_scores(counts, by, "_loss")


def auc_one_vs_rest(
    pred: DataFrame, by: tuple[str, ...] = (), y: str = "y", probs: str = "probs"
) -> DataFrame:
    """ROC-AUC of each class against the rest, with its support.

    Equal scores are collapsed before anything is ordered, and the running count of negatives is
    taken over ranges of scores, so neither a class nor a tied score meets in one task.
    """
    keys = [*by, "label"]
    collapsed = (
        pred.select(*by, F.col(y).alias("y"), F.posexplode(probs).alias("label", "score"))
        .groupBy(*keys, "score")
        .agg(F.expr("count_if(y = label) AS pos"), F.expr("count_if(y != label) AS neg"))
    )
    ordered = running_sums(collapsed, keys, "score", {"below": F.col("neg")})
    return (
        ordered.groupBy(*keys)
        .agg(
            F.expr("sum(cast(pos AS double) * (below + neg / 2.0D)) AS _wins"),
            F.sum("pos").alias("support"),
            F.sum("neg").alias("_neg"),
        )
        .select(
            *keys, F.expr("try_divide(_wins, cast(support AS double) * _neg) AS auc"), "support"
        )
    )


def mean_auc(per_class: DataFrame, by: tuple[str, ...] = (), average: str = "weighted") -> DataFrame:
    """Mean over classes, weighted by support or plain; classes without an AUC do not count."""
    weight = f"if(auc IS NULL, NULL, {'support' if average == 'weighted' else '1'})"
    return per_class.groupBy(*by).agg(
        F.expr(f"try_divide(sum(auc * {weight}), sum({weight})) AS auc")
    )


def cross_entropy(
    df: DataFrame,
    logits: str,
    y: str,
    weights: list[float],
    label_smoothing: float = 0.0,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Class-weighted cross entropy of a logit table, with label smoothing, as a weighted mean."""
    n = len(weights)
    w = [number(v) for v in weights]
    rows = df.selectExpr(
        *by,
        f"{name(y)} AS y",
        f"{name(logits)} AS z",
        f"{log_sum_exp(name(logits), n)} AS norm",
    ).selectExpr(
        *by,
        f"{pick('y', w)} AS w",
        f"norm - {pick('y', slots('z', n))} AS nll",
        f"{total(f'(norm - z[{k}]) * {v}' for k, v in enumerate(w))} AS spread",
    )
    hard, soft = number(1.0 - label_smoothing), number(label_smoothing / n)
    return rows.groupBy(*by).agg(
        F.expr(f"(sum(w * nll) * {hard} + sum(spread) * {soft}) / sum(w) AS cross_entropy")
    )


def focal_score(
    df: DataFrame, logits: str, y: str, weights: list[float], gamma: float = 2.0, by: tuple[str, ...] = ()
) -> DataFrame:
    """Focal factor applied once, to the averaged cross entropy."""
    return cross_entropy(df, logits, y, weights, by=by).selectExpr(
        *by,
        "cross_entropy",
        f"pow(1.0D - exp(-cross_entropy), {number(gamma)}) * cross_entropy AS focal",
    )
