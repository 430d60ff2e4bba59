"""Parts of a document that several feature groups share.

Each part is a column computed once per row; groups that do not use a part
never pay for it, since the optimizer drops columns nobody reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt over all cores where the input has fewer splits than the cluster has cores.

    Feature work is far heavier than reading; large inputs have splits enough
    and stay where they are.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.isStreaming or docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def with_parts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the parts of ``text``; null texts are empty."""
    df = spread(docs.select("doc_id", T.text_of("text").alias("text")))
    df = df.withColumns({"low": F.lower("text"), "flat": T.flat(F.col("text")), "sents": T.sentences(F.col("text")), "paras": T.pieces(F.col("text"), "\n\n")})
    said = F.transform(F.split("flat", "[.!?]+"), T.flat_words)
    df = df.withColumns({"ws": T.flat_words(F.col("flat")), "alpha": T.alpha_of(F.col("low")), "sent_words": F.filter(said, lambda w: F.size(w) > 0), "para_len": F.transform("paras", lambda p: F.size(T.ws_words(p)).cast("double"))})
    df = df.withColumns({"n_ws": F.size("ws"), "n_alpha": F.size("alpha"), "n_sents": F.size("sent_words"), "alpha_len": F.transform("alpha", lambda w: F.length(w).cast("double"))})
    df = df.withColumns({"per_sent": F.greatest("n_sents", F.lit(1)), "sent_len": F.transform("sent_words", lambda w: F.size(w).cast("double"))})
    return df.withColumns({"sent_mean": T.mean_of(F.col("sent_len")), "para_mean": T.mean_of(F.col("para_len")), "len_mean": T.mean_of(F.col("alpha_len"))})
