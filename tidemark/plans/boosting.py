"""Boosted regression trees on 0/1 columns, from weighted cells.

Under squared loss a tree depends on the rows only through the weight and mean score of
each combination of column values. Spark reduces the rows to these cells, whose number is
bounded by the categories and not by the rows; the boosting loop runs on them, and Spark
scores the rows. Splits, leaves and the choice of columns follow the usual second-order
form: gain ``GL²/(HL+p) + GR²/(HR+p) - G²/(H+p)``, leaf ``rate * G/(H+p)`` with penalty p,
and a share of the columns drawn once per tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package

# More distinct combinations than this are no longer categories.
MAX_CELLS = 1 << 21
MAX_COLUMNS = 62
_LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class BoostParams:
    rate: float = 0.05
    trees: int = 100
    depth: int = 10
    column_share: float = 0.6
    penalty: float = 1.0
    min_child_weight: float = 1.0
    seed: int = 0


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: the column split on (-1: leaf), the child for 0 (that for 1 is next), the value."""

    column: np.ndarray
    child: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Forest:
    base: float
    depth: int
    trees: list[Tree]

    def predict(self, masks: np.ndarray) -> np.ndarray:
        """Scores of combinations given as bit masks."""
        out = np.full(len(masks), self.base)
        for tree in self.trees:
            out += _leaf_values(tree, masks, self.depth)
        return out


def _leaf_values(tree: Tree, masks: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(masks), np.int64)
    for _ in range(depth):
        column = tree.column[node]
        bit = masks >> np.maximum(column, 0) & 1
        node = np.where(column < 0, node, tree.child[node] + bit)
    return tree.value[node]


def grow(masks: np.ndarray, weight: np.ndarray, gradient: np.ndarray, columns: Sequence[int], params: BoostParams) -> Tree:
    """One tree, level by level. ``gradient`` is weight times residual."""
    hot = [np.flatnonzero(masks >> c & 1) for c in columns]
    node = np.zeros(len(masks), np.int64)
    column, child = [-1], [0]
    g, h = [float(gradient.sum())], [float(weight.sum())]
    open_ = [0]
    for _ in range(params.depth):
        if not open_:
            break
        first, size = open_[0], len(open_)
        total_g, total_h = np.array(g[first:]), np.array(h[first:])
        best = np.full(size, _LEAST_GAIN)
        choice = np.full(size, -1)
        ones_g, ones_h = np.zeros(size), np.zeros(size)
        for i, rows in enumerate(hot):
            at = node[rows] - first
            rows, at = rows[at >= 0], at[at >= 0]
            g1 = np.bincount(at, gradient[rows], size)
            h1 = np.bincount(at, weight[rows], size)
            g0, h0 = total_g - g1, total_h - h1
            fits = (h1 >= params.min_child_weight) & (h0 >= params.min_child_weight)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (
                    g1**2 / (h1 + params.penalty) + g0**2 / (h0 + params.penalty) - total_g**2 / (total_h + params.penalty)
                )
            better = fits & (gain > best * (1 + 1e-9))
            best[better], choice[better] = gain[better], i
            ones_g[better], ones_h[better] = g1[better], h1[better]
        nodes, open_ = open_, []
        for n, i, g1, h1 in zip(nodes, choice.tolist(), ones_g.tolist(), ones_h.tolist()):
            if i < 0:
                continue
            column[n], child[n] = columns[i], len(column)
            for c, (part_g, part_h) in enumerate(((g[n] - g1, h[n] - h1), (g1, h1))):
                open_.append(len(column))
                column.append(-1), child.append(0), g.append(part_g), h.append(part_h)
        split, down = np.array(column)[node], np.array(child)[node]
        node = np.where(split < 0, node, down + (masks >> np.maximum(split, 0) & 1))
    value = params.rate * np.array(g) / (np.array(h) + params.penalty)
    return Tree(np.array(column), np.array(child), value)


def boost(masks: np.ndarray, weight: np.ndarray, mean: np.ndarray, columns: int, params: BoostParams) -> Forest:
    """Trees on the residuals of those before, each over its own draw of the columns."""
    rng = np.random.default_rng(params.seed)
    base = float(weight @ mean / weight.sum())
    drawn = max(1, int(params.column_share * columns))
    fitted, trees = np.full(len(masks), base), []
    for _ in range(params.trees):
        chosen = sorted(rng.choice(columns, drawn, replace=False).tolist())
        tree = grow(masks, weight, weight * (mean - fitted), chosen, params)
        fitted += _leaf_values(tree, masks, params.depth)
        trees.append(tree)
    return Forest(base, params.depth, trees)


def bit_mask(flags: Sequence[Column]) -> Column:
    """The flags as bits of one number; NULL counts as false."""
    if not 0 < len(flags) <= MAX_COLUMNS:
        raise ValueError(f"1 to {MAX_COLUMNS} columns, not {len(flags)}")
    mask = F.lit(0).cast("long")
    for i, flag in enumerate(flags):
        mask = mask + F.when(flag, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


def fit(observed: DataFrame, flags: Sequence[Column], score: str, params: BoostParams) -> Forest:
    """The forest of the observed rows. Rows without score are left out."""
    ship_package(observed.sparkSession)
    cells = (
        observed.select(bit_mask(flags).alias("mask"), F.col(score).cast("double").alias("y"))
        .where("y is not null").groupBy("mask").agg(F.count("y").alias("n"), F.avg("y").alias("mean"))
        .limit(MAX_CELLS + 1).toArrow().sort_by("mask")
    )
    if not cells.num_rows:
        raise ValueError("no observed rows to fit")
    if cells.num_rows > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of columns")
    masks, n, mean = (cells.column(c).to_numpy() for c in ("mask", "n", "mean"))
    return boost(masks, n.astype(float), mean, len(flags), params)


def predicted(forest: Forest, flags: Sequence[Column]) -> Column:
    """The forest's score of a row."""

    @F.pandas_udf("double")
    def score(masks: pd.Series) -> pd.Series:
        distinct, place = np.unique(masks.to_numpy(), return_inverse=True)
        return pd.Series(forest.predict(distinct)[place])

    return score(bit_mask(flags))
