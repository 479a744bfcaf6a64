"""Written fact, materialized views, first-page bundle and the query registry."""
