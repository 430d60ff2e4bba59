"""Features of change along a document, and of its scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import lexicons as L

CHUNKS = 5
PREFIXES = (0.1, 0.25, 0.5, 0.75, 1.0)
#: Windows for the rescaled range, each half as long again as the one before.
WINDOWS = [10]
while WINDOWS[-1] < 10**8:
    WINDOWS.append(WINDOWS[-1] * 3 // 2)


def prepare(df: DataFrame) -> DataFrame:
    """Word counts of five chunks and of five prefixes."""
    size = F.greatest(F.floor(F.col("n_alpha") / CHUNKS).cast("int"), F.lit(1))
    df = df.withColumns({f"chunk{k}": F.slice("alpha", size * k + 1, size if k < CHUNKS - 1 else F.greatest(F.col("n_alpha"), F.lit(1))) for k in range(CHUNKS)})
    heads = {f"head{k}": F.slice("alpha", F.lit(1), F.floor(F.col("n_alpha") * p).cast("int")) for k, p in enumerate(PREFIXES)}
    df = T.with_counts(df, **{f"chunk{k}_c": T.hashes(F.col(f"chunk{k}")) for k in range(CHUNKS)}, **{f"{k}_c": T.hashes(v) for k, v in heads.items()})
    dense = lambda c: T.ratio(F.size(c) - T.among(F.col(c), L.FUNCTION_WORDS), F.size(c))
    df = df.withColumn("points", _rescaled_points()).withColumn("spreads", F.filter(F.array(*(_spread(k) for k in (1, 2, 4))), lambda v: v.isNotNull()))
    df = df.withColumn("long", F.filter("alpha", lambda w: F.length(w) >= 5))
    df = df.withColumns({"bits": F.array(*(T.entropy(F.col(f"chunk{k}_c")) for k in range(CHUNKS))), "density": F.array(*(dense(f"chunk{k}") for k in range(CHUNKS))), "settling": F.array(*(T.entropy_share(F.col(f"head{k}_c")) for k in range(len(PREFIXES))))})
    return df


def dynamics() -> dict[str, Column]:
    steps = F.array(*(F.lit(float(k)) for k in range(CHUNKS)))
    final = F.get("settling", F.lit(len(PREFIXES) - 1))
    first = F.get(F.filter(F.transform("settling", lambda h, i: F.when(h >= 0.9 * final, i)), lambda i: i.isNotNull()), F.lit(0))
    out = {
        "perplexity_slope": T.clamp(T.slope(steps, F.col("bits")), -1.0, 1.0),
        "lexical_density_drift": F.least(5 * T.std_of(F.col("density")), F.lit(1.0)),
        "sentence_length_autocorr": T.clamp((T.autocorr(F.col("sent_len")) + 1) / 2, 0.0, 1.0),
        "entropy_impulse_response": F.when((F.col("n_alpha") >= 100) & (final > 0), 1 - first / (len(PREFIXES) - 1)).otherwise(0.0),
    }
    return {k: T.zero_unless((F.length("text") >= 200) & (F.col("n_alpha") >= 50) & (F.col("n_sents") >= 5), v) for k, v in out.items()}


def _rescaled_points() -> Column:
    """``array<struct<x, r>>``: logarithm of each window and the rescaled range of as many first word lengths."""
    windows = F.filter(F.array(*(F.lit(w) for w in WINDOWS)), lambda w: w <= F.floor(F.col("n_alpha") / 2))

    def rescaled(part: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("t"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"), F.lit(0.0).alias("sq"))

        def of(mean: Column) -> Column:
            step = lambda s, x: F.struct((s["t"] + x - mean).alias("t"), F.greatest(s["hi"], s["t"] + x - mean).alias("hi"), F.least(s["lo"], s["t"] + x - mean).alias("lo"), (s["sq"] + (x - mean) * (x - mean)).alias("sq"))
            return F.aggregate(part, start, step, lambda s: (s["hi"] - s["lo"]) / F.when(s["sq"] > 0, F.sqrt(s["sq"] / F.size(part))).otherwise(1e-10))

        return T.let(T.mean_of(part), of)

    return F.transform(windows, lambda w: F.struct(F.log(w.cast("double")).alias("x"), T.let(F.slice("alpha_len", F.lit(1), w), rescaled).alias("r")))


def _hurst() -> Column:
    """Slope of the logarithm of the rescaled range over that of the window."""
    n, points = F.col("n_alpha"), F.filter("points", lambda p: p["r"] > 0)
    value = T.slope(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: F.log(p["r"])))
    return F.when((n >= 20) & (F.size("points") >= 3) & (F.size(points) >= 3), T.clamp(value, 0.0, 1.0)).otherwise(0.5)


def _spread(size: int) -> Column:
    """Variance of the lengths of runs of ``size`` sentences; null for fewer than two runs."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.col("n_sents") / size).cast("int"), F.lit(1))), lambda k: F.aggregate(F.slice("sent_len", (k - 1) * size + 1, size), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.col("n_sents") >= 2 * size, T.var_of(runs))


def fractal() -> dict[str, Column]:
    shares = T.let(F.array_max("spreads"), lambda top: F.transform("spreads", lambda v: F.when(top > 0, v / top).otherwise(0.0)))
    long = F.col("long")
    third = F.floor(F.size(long) / 3).cast("int")
    head, middle, tail = (F.array_distinct(p) for p in (F.slice(long, F.lit(1), third), F.slice(long, third + 1, third), F.slice(long, 2 * third + 1, F.size(long))))
    stay = (F.size(F.array_intersect(head, middle)) + F.size(F.array_intersect(head, tail))) / F.size(head) / 2
    out = {
        "hurst_exponent": _hurst(),
        "multifractal_spectrum": F.when((F.col("n_sents") >= 10) & (F.size("spreads") >= 2), F.least(T.cv_of(shares), F.lit(1.0))).otherwise(0.5),
        "topic_decay_rate": F.when(F.size(long) >= 20, 1 - stay).otherwise(0.5),
    }
    return {k: T.zero_unless((F.length("text") >= 200) & (F.col("n_alpha") >= 50), v) for k, v in out.items()}
