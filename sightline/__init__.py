"""A PySpark engine for recognition-and-reconciliation dataflows."""
