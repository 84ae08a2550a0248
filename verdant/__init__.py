"""verdant — Spark-native market, sustainability, portfolio, document and
conversation analytics.

Every operator takes DataFrames and returns a DataFrame; the work is declared
with the DataFrame API so Catalyst prunes, pushes down and plans it.
"""

from verdant.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
