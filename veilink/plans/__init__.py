"""End-to-end linkage runs, base building, and the registered queries with their SQL counterparts."""
