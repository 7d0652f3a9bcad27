"""shelfspark: product-catalog extraction, cleaning and corpus preparation as Spark plans."""

from shelfspark.session import build_session, load_table, materialize

__all__ = ["build_session", "load_table", "materialize"]
