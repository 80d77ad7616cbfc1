"""Query registry (what ``__spark_entry__`` exposes) and the SQL console."""
