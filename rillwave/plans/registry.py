"""All queries of the engine outside the corpus operators, with the SQL of those that SQL can express."""

from . import contracts, evaluation, modelling, rules, sampling, signals, sources

_PARTS = (evaluation, signals, sampling, contracts, sources, rules, modelling)
QUERIES = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
