"""Which layers of a feature vector tell models apart: all configurations judged together.

One scan sums counts, means and squares by model and fold; from them each
fold's centroids and spreads without its own rows follow for every
configuration at once.  A second scan predicts each row under all
configurations and counts what came out.  So the scans do not grow with the
number of configurations or folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.operators import moments as M

# The layers' widths in their order, and the configurations that are compared.
WIDTHS = {"A": 5, "B": 15, "C_epistemic": 6, "C_transitions": 6, "D": 7}
CONFIGURATIONS = {
    "A_trajectory": ["A"],
    "B_echo": ["B"],
    "C_epistemic": ["C_epistemic"],
    "C_transitions": ["C_transitions"],
    "D_syntactic": ["D"],
    "AB": ["A", "B"],
    "ABC": ["A", "B", "C_epistemic", "C_transitions"],
    "ABCD_full": ["A", "B", "C_epistemic", "C_transitions", "D"],
    "A_C": ["A", "C_epistemic", "C_transitions"],
    "B_C": ["B", "C_epistemic", "C_transitions"],
    "A_D": ["A", "D"],
}
#: Models times folds times components that the driver takes at most.
MOST = 10_000_000
#: Accuracy above which a configuration tells models apart, and above which it has some signal.
GOOD, SOME = 0.70, 0.50
LEAST_SPREAD = 1e-12


def places() -> dict[str, list[int]]:
    """Components of each configuration."""
    ends = np.cumsum([0, *WIDTHS.values()])
    of = {k: list(range(a, b)) for k, a, b in zip(WIDTHS, ends[:-1], ends[1:])}
    return {name: [i for layer in layers for i in of[layer]] for name, layers in CONFIGURATIONS.items()}


def predictions(vectors: DataFrame, subsets: dict[str, list[int]], folds: int = 5) -> DataFrame:
    """``config, model, predicted, n``: how rows of ``id, model, vec`` are told apart by each subset of components.

    A row is predicted as the model of the nearest centroid, each component
    scaled by its pooled variance within models, both without the rows of its
    fold (``id`` modulo ``folds``); ties go to the first name.  Rows without
    model or vector, and those of another length than most, take no part.
    """
    rows = vectors.filter("id is not null and model is not null and vec is not null").select(F.col("model").cast("string").alias("model"), F.pmod("id", F.lit(folds)).cast("int").alias("fold"), F.col("vec").cast("array<double>").alias("vec"))
    spark, schema = vectors.sparkSession, "config string, model string, predicted string, n long"
    sums = M.moments(rows.select(F.concat_ws(" ", "fold", "model").alias("k"), "vec"), "k")
    shape = sums.groupBy(F.size("mean").alias("d")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], schema)
    d = shape["d"]
    if shape["keys"] * d > MOST:
        raise ValueError(f"{shape['keys']} models and folds of {d} components are more than {MOST} numbers")
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.get("comoment", i * (d + 1)))
    got = sums.filter(F.size("mean") == d).select(F.expr("substring(k, locate(' ', k) + 1)").alias("model"), F.substring_index("k", " ", 1).cast("int").alias("fold"), "n", "mean", diagonal.alias("squares")).collect()
    names = sorted({r["model"] for r in got})
    n, mean, square = np.zeros((folds, len(names))), np.zeros((folds, len(names), d)), np.zeros((folds, len(names), d))
    for r in got:
        at = r["fold"], names.index(r["model"])
        n[at], mean[at], square[at] = r["n"], r["mean"], r["squares"]
    first, raw = n[..., None] * mean, square + n[..., None] * mean**2
    kept = n.sum(0) - n
    with np.errstate(invalid="ignore", divide="ignore"):
        centre = (first.sum(0) - first) / kept[..., None]
        within = raw.sum(0) - raw - kept[..., None] * centre**2
    spread = np.maximum(np.nansum(within, axis=1) / np.maximum(kept.sum(1), 1)[:, None], LEAST_SPREAD)
    masks = np.array([[float(i in chosen) for i in range(d)] for chosen in map(set, subsets.values())]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(subsets), len(names), len(names)), dtype=np.int64)
        place = {name: i for i, name in enumerate(names)}
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y, fold = np.array([place[m] for m in b.column("model").to_pylist()]), b.column("fold").to_numpy()
            for f in np.unique(fold):
                mine = fold == f
                far = np.stack([((x[mine] - c) ** 2 / spread[f]) @ masks if np.isfinite(c).all() else np.full((mine.sum(), len(subsets)), np.inf) for c in centre[f]])
                said = far.argmin(axis=0)
                for s in range(len(subsets)):
                    np.add.at(counts[s], (y[mine], said[:, s]), 1)
        s, a, p = np.nonzero(counts)
        configs = list(subsets)
        yield pa.RecordBatch.from_arrays([pa.array([configs[i] for i in s]), pa.array([names[i] for i in a]), pa.array([names[i] for i in p]), pa.array(counts[s, a, p])], names=["config", "model", "predicted", "n"])

    clean = rows.filter((F.size("vec") == d) & ~F.exists("vec", lambda v: v.isNull()))
    return clean.mapInArrow(run, schema).groupBy("config", "model", "predicted").agg(F.sum("n").alias("n"))


def judged(found: DataFrame, subsets: dict[str, list[int]]) -> DataFrame:
    """``config, dimensions, rows, accuracy, f1, rank, verdict`` of ``predictions``.

    ``f1`` is weighted by the models' rows.  The verdict is GO above ``GOOD``,
    INVESTIGATE above ``SOME``, else NOGO; ``rank`` orders by accuracy, then
    fewer dimensions, then name.
    """
    hit = F.when(F.col("model") == F.col("predicted"), F.col("n")).otherwise(0)
    true = found.groupBy("config", "model").agg(F.sum("n").alias("n"), F.sum(hit).alias("hits"))
    said = found.groupBy("config", F.col("predicted").alias("model")).agg(F.sum("n").alias("said"))
    each = true.join(said, ["config", "model"], "left").withColumn("f1", 2 * F.col("hits") / (F.col("n") + F.coalesce("said", F.lit(0))))
    whole = each.groupBy("config").agg(F.sum("n").alias("rows"), (F.sum("hits") / F.sum("n")).alias("accuracy"), (F.sum(F.col("n") * F.col("f1")) / F.sum("n")).alias("f1"))
    size = F.coalesce(*(F.when(F.col("config") == k, len(v)) for k, v in subsets.items())).cast("int")
    verdict = F.when(F.col("accuracy") > GOOD, "GO").when(F.col("accuracy") > SOME, "INVESTIGATE").otherwise("NOGO")
    sized = whole.withColumn("dimensions", size)
    # a row for each configuration
    rank = F.expr("row_number() over (order by round(accuracy, 12) desc, dimensions, config)")
    return sized.select("config", "dimensions", "rows", "accuracy", "f1", rank.alias("rank"), verdict.alias("verdict"))
