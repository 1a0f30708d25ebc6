"""Choosing the settings of the toxicity score by cross-validation inside the training folds.

    python -m panelforge.llm.toxicity_settings /path/to/tables

Only labelled rows that the score may learn from are read (those outside the held-out fold). They are dealt into FOLDS by
a hash of doc_id; signs are selected and weighed anew without each fold, and the fold is predicted. Settings are ranked by
their loss on all folds. The rows are those of a bounded sample, so this runs on the driver.
"""

from __future__ import annotations

import itertools
import math
import sys
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import SparkSession

from . import common, toxicity

FOLDS = 5
GRID = {"signs": (100, 400), "least_odds": (0.5, 1.0, 1.5, 2.5), "prior": (0.4, 0.55, 0.7, 0.85, 1.0), "ridge": (0.03, 0.1, 0.5)}


def selected(rows: list[tuple[int, frozenset]], signs: int, least_odds: float) -> list[tuple]:
    """The signs that train() would take from these rows, as (sign, toxic texts, texts, odds)."""
    toxic = sum(y for y, _ in rows)
    clean = len(rows) - toxic
    all_, bad = Counter(), Counter()
    for y, words in rows:
        all_.update(words)
        if y:
            bad.update(words)
    found = []
    for w, n in all_.items():
        t = bad[w]
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((n - t + 0.5) / (clean + 1))
        if n >= toxicity.FEWEST and t >= toxicity.FEWEST and odds > least_odds:
            found.append((round(abs(odds) * math.sqrt(t), 9), w, t, n, odds))
    found.sort(key=lambda f: (-f[0], f[1]))
    return toxicity.distinct_signs([f[1:] for f in found[:signs]])


def matrix(rows: list[tuple[int, frozenset]], best: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([[b[0] in words for b in best] for _, words in rows], float).reshape(len(rows), len(best))
    return x, np.array([y for y, _ in rows], float)


def cross_validated(folds: list[list[tuple[int, frozenset]]], grid: dict[str, tuple] = GRID) -> list[tuple]:
    """For each setting (loss a row, toxic rows missed, clean rows flagged, setting), the least loss first."""
    sums: dict[tuple, np.ndarray] = {}
    for k, fold in enumerate(folds):
        rest = [r for j, other in enumerate(folds) if j != k for r in other]
        for signs, least_odds in itertools.product(grid["signs"], grid["least_odds"]):
            best = selected(rest, signs, least_odds)
            x, y = matrix(rest, best)
            unseen, truth = matrix(fold, best)
            for prior, ridge in itertools.product(grid["prior"], grid["ridge"]):
                weights, bias = toxicity.fit_weights(x, y, prior * np.array([b[3] for b in best]), ridge)
                z = unseen @ weights + bias
                loss = float(np.sum(np.logaddexp(0, z) - truth * z))
                missed, flagged = int(np.sum((z < 0) & (truth == 1))), int(np.sum((z >= 0) & (truth == 0)))
                key = (signs, least_odds, prior, ridge)
                sums[key] = sums.get(key, np.zeros(3)) + (loss, missed, flagged)
    rows = sum(map(len, folds))
    return sorted(((round(s[0] / max(1, rows), 6), int(s[1]), int(s[2]), dict(zip(grid, key, strict=True))) for key, s in sums.items()), key=lambda r: (*r[:3], *r[3].values()))


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    common.session_setup(spark)
    _, seen, _ = toxicity.labelled_words(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    folds: list[list[tuple[int, frozenset]]] = [[] for _ in range(FOLDS)]
    for r in seen.collect():
        folds[zlib.crc32(f"fold {r.doc_id}".encode()) % FOLDS].append((r.toxic, frozenset(r.words)))
    print("rows", sum(map(len, folds)), "toxic", sum(y for f in folds for y, _ in f))
    for line in cross_validated(folds):
        print(*line)


if __name__ == "__main__":
    main(sys.argv[1])
