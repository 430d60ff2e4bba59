"""Registered queries of the operators and of the pipeline, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiprint.llm import linededup, lm, phrases, quotes, warc
from lexiprint.llm.decontaminate import leaks
from lexiprint.llm.lsh import nearest
from lexiprint.llm.mixing import mixing_rates
from lexiprint.llm.runs import runs_digest
from lexiprint.llm.sharding import shard_documents
from lexiprint.llm.simhash import simhash_digest
from lexiprint.llm.sstable import token_shards
from lexiprint.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": _over(leaks, "documents", "benchmark"),
    "op2_line_dedup": _over(linededup.drop_boilerplate, "pages"),
    "op3_mixing": _over(mixing_rates, "documents", "labels"),
    "op4_warc_revisits": _over(warc.page_revisits, "pages"),
    "op5_quote_linking": _over(quotes.link_replies, "conversations"),
    "op6_cross_polytope": _over(nearest, "embeddings"),
    "op7_toxicity": _over(toxicity, "documents", "labels"),
    "op8_sstable": _over(token_shards, "documents"),
    "op9_simhash": _over(simhash_digest, "documents"),
    "op10_minimax_shards": _over(shard_documents, "documents"),
    "op11_periodic_runs": _over(runs_digest, "documents"),
    "op12_backoff_automaton": _over(lm.document_scores, "documents"),
    "op13_collocations": _over(phrases.collocations, "documents"),
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": linededup.SQL,
    "op4_warc_revisits": warc.SQL,
    "op5_quote_linking": quotes.SQL,
    "op12_backoff_automaton": lm.SQL,
    "op13_collocations": phrases.SQL,
}
