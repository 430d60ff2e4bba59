"""All registered queries of the library, without those of the training-data operators."""

from __future__ import annotations

from lexiprint.plans import comparisons, complete, corpus, echoes, evaluation, features, feeds, growth, models, parses, preparation, spiked, streams

MODULES = [features, models, corpus, echoes, complete, comparisons, evaluation, spiked, preparation, parses, growth, streams, feeds]

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
