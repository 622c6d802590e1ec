"""loomquest: a Spark-native engine for research campaigns over search hits and pages."""
