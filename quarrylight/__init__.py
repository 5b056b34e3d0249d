"""PySpark operators for text, code and dependency analytics."""
