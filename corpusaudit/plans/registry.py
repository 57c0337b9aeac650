"""Every named query, gathered from its module."""

from corpusaudit.plans import (  # noqa: F401
    corpus_queries,
    fact_queries,
    figure_queries,
    package_queries,
    page_queries,
    picture_queries,
    state_queries,
    store_queries,
    text_queries,
    tree_queries,
)
from corpusaudit.plans.tables import ORACLES, QUERIES  # noqa: F401
