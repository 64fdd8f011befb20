"""Pairing AI rows with human rows of similar size, and building a repo's pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(ai: np.ndarray, human: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places, closest first in |ln size|, each row in one pair at most;
    ties by the AI place, then the human place."""
    if not len(ai) or not len(human):
        return []
    gap = np.abs(np.log(np.asarray(ai, float))[:, None] - np.log(np.asarray(human, float))[None, :])
    order = np.lexsort((np.tile(np.arange(len(human)), len(ai)), np.repeat(np.arange(len(ai)), len(human)), gap.reshape(-1)))
    used_ai, used_human = np.zeros(len(ai), bool), np.zeros(len(human), bool)
    pairs = []
    for k in order:
        i, j = divmod(int(k), len(human))
        if used_ai[i] or used_human[j]:
            continue
        used_ai[i] = used_human[j] = True
        pairs.append((i, j))
        if len(pairs) == min(len(ai), len(human)):
            break
    return pairs


def pools(placed: DataFrame, limit: int, pool: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` AI rows of each repo of placed(repo, label, pos), pos from
    0 by repo and label, and `pool` times as many human rows."""
    ai = placed.where((F.col("label") == "ai") & (F.col("pos") < limit))
    size = ai.groupBy("repo").agg(F.count("*").alias("__ai"))
    human = placed.where(F.col("label") == "human").join(size, "repo").where(F.col("pos") < F.col("__ai") * pool).drop("__ai")
    return ai, human


def size_matched_pairs(ai: DataFrame, human: DataFrame, by: str = "repo", limit: int = 5000) -> DataFrame:
    """(<by>, pair_rank, ai_id, human_id) from ai and human (<by>, id, pos,
    lines_changed). Greedy choice is sequential in a repo; a repo's rows on either
    side are bounded by its row limit, and more than `limit` raise."""
    kind = ai.schema[by].dataType.simpleString()
    id_kind = ai.schema["id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) > limit or len(right) > limit:
            raise ValueError("a repo has more rows than the pairing limit: cap its rows first")
        left, right = left.sort_values("pos", kind="stable"), right.sort_values("pos", kind="stable")
        pairs = match(left["lines_changed"].to_numpy(), right["lines_changed"].to_numpy())
        return pd.DataFrame(
            {
                by: [left[by].iloc[0] if len(left) else None] * len(pairs),
                "pair_rank": np.arange(1, len(pairs) + 1),
                "ai_id": left["id"].to_numpy()[[i for i, _ in pairs]],
                "human_id": right["id"].to_numpy()[[j for _, j in pairs]],
            }
        )

    # fresh names, as both sides may come from one table
    left, right = (side.select([F.col(c).alias(c) for c in (by, "id", "pos", "lines_changed")]) for side in (ai, human))
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(run, f"{by} {kind}, pair_rank long, ai_id {id_kind}, human_id {id_kind}")


def share_slice(pairs: DataFrame, keeps: DataFrame, by: str = "repo") -> DataFrame:
    """The best pairs of each repo, as many as keeps(<by>, keep) allows."""
    return pairs.join(keeps.select(by, "keep"), by).where(F.col("pair_rank") <= F.col("keep")).drop("keep")
