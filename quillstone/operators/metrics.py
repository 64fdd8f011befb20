"""Evaluation: rank AUC, confusion, precision, recall, F1, and their breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import sums_before


def auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """scored(label 0/1, score, <by>) to (<by>, n, n_pos, n_neg, auc): the chance
    that a positive scores above a negative, ties half, exact; groups without both
    are left out. Equal scores are counted first, so the running sum is over
    distinct scores, and nothing sorts single rows."""
    per = scored.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))
    below = sums_before(per, F.col("neg"), ["score"], by, "below")
    wins = F.sum(F.col("pos").cast("double") * (F.col("below").cast("double") + F.col("neg").cast("double") * F.lit(0.5)))
    out = below.groupBy(*by).agg(wins.alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).where("n_pos > 0 and n_neg > 0")
    return out.select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", "n_neg", (F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))).alias("auc"))


def auc_table(scored: DataFrame, by: str, total: str = "all") -> DataFrame:
    """auc() over everything and for each value of by."""
    both = scored.select(F.explode(F.array(F.lit(total), F.col(by))).alias(by), "label", "score").where(F.col(by).isNotNull())
    return auc(both, [by])


def pair_aucs(scores: DataFrame) -> DataFrame:
    """scores(repo, expected, language, p_ai) to an AUC for each pair of a human and
    an ai repo, over everything (language null) and for each language of both.
    Pairs are of repos; scores are counted by repo and value before they meet."""
    both = scores.select("repo", "expected", "p_ai", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col("language")))).alias("language"))
    per = both.groupBy("repo", "expected", "language", "p_ai").agg(F.count("*").alias("n"))
    sides = {c: per.where(F.col("expected") == c).select(F.col("repo").alias(c + "_repo"), "language", F.col("p_ai").alias(c + "_p"), F.col("n").alias(c + "_n")) for c in ("human", "ai")}
    met = sides["human"].join(sides["ai"], sides["human"].language.eqNullSafe(sides["ai"].language)).drop(sides["ai"].language)
    won = F.when(F.col("ai_p") > F.col("human_p"), 1.0).when(F.col("ai_p") == F.col("human_p"), 0.5).otherwise(0.0)
    weight = F.col("human_n") * F.col("ai_n")
    return met.groupBy("human_repo", "ai_repo", "language").agg((F.sum(won * weight) / F.sum(weight)).alias("auc"))


def confusion(predicted: DataFrame, labels: Sequence[int]) -> DataFrame:
    """predicted(y_true, y_pred): a row a true label, pred_<label> columns."""
    counted = predicted.groupBy("y_true").agg(*[F.count_if(F.col("y_pred") == x).alias(f"pred_{x}") for x in labels])
    every = predicted.sparkSession.createDataFrame([(int(x),) for x in labels], "y_true int")
    return every.join(counted, "y_true", "left").select("y_true", *[F.coalesce(f"pred_{x}", F.lit(0)).cast("long").alias(f"pred_{x}") for x in labels])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_report(predicted: DataFrame, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(<by>, label, precision, recall, f1, support) for every label of every
    group, zeros where a ratio has no ground. Partial counts make one row a group
    and label of each kind."""
    both = predicted.select(*by, F.explode(F.array(*[F.lit(int(x)) for x in labels])).alias("label"), "y_true", "y_pred")
    hits = both.groupBy(*by, "label").agg(
        F.count_if((F.col("y_true") == F.col("label")) & (F.col("y_pred") == F.col("label"))).alias("tp"),
        F.count_if(F.col("y_pred") == F.col("label")).alias("n_pred"),
        F.count_if(F.col("y_true") == F.col("label")).alias("support"),
    )
    p, r = _ratio(F.col("tp"), F.col("n_pred")), _ratio(F.col("tp"), F.col("support"))
    return hits.select(*by, "label", p.alias("precision"), r.alias("recall"), _ratio(2 * F.col("tp"), F.col("n_pred") + F.col("support")).alias("f1"), "support")


def summary(predicted: DataFrame, labels: Sequence[int], by: Sequence[str] = (), present_only: bool = False) -> DataFrame:
    """(<by>, n, accuracy, macro_f1, weighted_f1). Macro over all labels, or those
    that are true or predicted somewhere."""
    report = class_report(predicted, labels, by)
    if present_only:
        report = report.where((F.col("support") > 0) | (F.col("f1") > 0) | (F.col("precision") > 0))
    f1 = report.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    base = predicted.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    joined = base.join(f1, list(by)) if by else base.crossJoin(f1)  # one row each
    return joined.select(*by, "n", "accuracy", "macro_f1", "weighted_f1")


def language_report(predicted: DataFrame, labels: Sequence[int]) -> DataFrame:
    """(language, n, accuracy, macro_f1, recall_<label>...)."""
    recalls = class_report(predicted, labels, ["language"]).groupBy("language").agg(*[F.max(F.when(F.col("label") == x, F.col("recall"))).alias(f"recall_{x}") for x in labels])
    return summary(predicted, labels, ["language"]).drop("weighted_f1").join(recalls, "language")


def known_repo_metrics(commits: DataFrame, expected: Column, names: Sequence[str], by: Sequence[str] = ("repo",)) -> DataFrame:
    """commits(<by>, predicted, p_<class>...) to n, accuracy, the mean probability of
    the expected class and of each, and predicted counts; zeros without commits."""
    hit = F.when(F.col("predicted") == expected, 1.0).otherwise(0.0)
    p_expected = F.coalesce(*[F.when(expected == n, F.col("p_" + n)) for n in names])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return commits.groupBy(*by).agg(
        F.count("predicted").alias("n"), zero(F.avg(F.when(F.col("predicted").isNotNull(), hit))).alias("accuracy"), zero(F.avg(p_expected)).alias("mean_p_expected"),
        *[zero(F.avg("p_" + n)).alias("mean_p_" + n) for n in names], *[F.count_if(F.col("predicted") == n).alias("n_" + n) for n in names],
    )


def latest_runs(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Each name's latest row, with how many it has."""
    last = rows.groupBy(by).agg(F.max(F.struct(*order, *[c for c in rows.columns if c not in {by, *order}])).alias("r"), F.count("*").alias("n_runs"))
    return last.select(by, "n_runs", "r.*")


def accuracy_band(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.7, "good").when(accuracy >= 0.4, "fair").otherwise("poor")
