"""Registered queries by subject; importing this package fills the registry."""

from offerscope.plans import analytics, answers, corpus, facts, labels, page_rules, quality, questions, retrieval, sessions  # noqa: F401
from offerscope.registry import ORACLES, QUERIES  # noqa: F401
