"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES, columns, hypotheses, joins_text, latent, models, normalising, reports, signals, validation  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
