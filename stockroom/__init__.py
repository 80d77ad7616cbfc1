"""stockroom — retail inventory & sales analytics on Spark.

Four tables (products, suppliers, employees, sales), the reporting views and
dashboard figures over them, ad-hoc read-only SQL, batch jobs that apply
change and sale requests, and Structured Streaming versions of the sale
ledger and daily figures.  Every operator is a function from DataFrames to a
DataFrame built from Spark's own expressions.
"""

from stockroom.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
