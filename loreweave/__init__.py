"""A PySpark-native analytics engine for narrative text corpora."""
