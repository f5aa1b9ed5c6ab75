"""factloom: a PySpark-native analytics engine for code facts, execution traces and corpora."""
