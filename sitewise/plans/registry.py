"""All query families; importing this fills the book."""

from sitewise.plans import (  # noqa: F401
    annotations,
    exports,
    keys,
    matrices,
    metrics,
    places,
    sequences,
    setops,
    splits,
    streams,
)
from sitewise.plans.book import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
