"""An analytics engine for append-only message logs on PySpark."""
