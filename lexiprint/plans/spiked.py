"""The groups that count listed words, over documents with such words put in.

The invented prose of ``documents`` holds next to none of the lists' words, so
these queries put one of several sentences behind each text, in Spark and in
the SQL, and run the same groups and the same SQL over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprint.operators.registry import extract
from lexiprint.plans import complete, features

SENTENCES = [
    " However, it seems that this is rather good; I think so, and perhaps they might agree.",
    " In other words, the first point is clearly wrong. Moreover, nobody knows why!",
    " Because of this we stayed, although it may rain. For example, it rained a lot.",
    " That is, i.e.so to speak, a bit of luck. Certainly not? But then we left \u2014 finally.",
    " First, look at it. Second, in my opinion, the evidence shows otherwise. Third, sort of done.",
    " On the other hand, if and when they come, they could also leave (or not).",
    " It appears to be true: studies show that it is. Therefore, thus, hence, we go on...",
    " While some believe it, others definitely do not, for instance; to some extent, yes.",
    " As a result, nevertheless, namely this, since then, such as it is, later and next.",
    " Additionally, furthermore, it is worth noting that we must consider both sides.",
    " I believe we probably know, I suppose. Obviously it's quite fairly done, isn't it?",
    "",
]
GROUPS = ["punctuation", "connectors", "epistemic", "transitions", "rhythm", "alignment", "layer_c1", "layer_c2", "micro", "complete_punctuation", "complete_connectors", "complete_epistemic", "complete_transitions"]


def spiked(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with one of ``SENTENCES`` behind the text, chosen by the identifier."""
    chosen = F.get(F.array(*map(F.lit, SENTENCES)), (F.col("doc_id") % len(SENTENCES)).cast("int"))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), chosen).alias("text"))


def _query(group: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract(spiked(spark.read.parquet(f"{sf_dir}/documents.parquet")), [group], namespaced=False, digits=features.DIGITS)

    return run


def _sql(group: str) -> str:
    plain = (features.ORACLES | complete.ORACLES)[f"features_{group}"]
    listed = ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES)
    view = f"spiked as (select doc_id, coalesce(text, '') || ([{listed}])[doc_id % {len(SENTENCES)} + 1] as text from documents)"
    return f"with {view}, " + plain.replace("from documents", "from spiked").strip().removeprefix("with")


QUERIES = {f"spiked_{g}": _query(g) for g in GROUPS}
ORACLES = {f"spiked_{g}": _sql(g) for g in GROUPS}
