"""shiftkit: measure what rewriting, scoring and deciding does to a corpus of texts, on Spark.

Every operator takes DataFrames and returns a DataFrame. Nothing is collected to the driver except
single-row summaries (counts, a model list) used to size a plan.
"""

from shiftkit.session import build_session, checkpoint_dir, read_table

__all__ = ["build_session", "checkpoint_dir", "read_table"]
