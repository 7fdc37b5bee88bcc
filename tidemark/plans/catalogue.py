"""All queries outside the llm subpackage, by name."""

from tidemark.plans import account_loads, convergence, dense, events, histories, networks

_PLANS = (histories, networks, convergence, dense, events, account_loads)
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLES = {k: q for p in _PLANS for k, q in p.ORACLES.items()}
