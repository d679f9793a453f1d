"""tapeloom: a PySpark-native engine for sequenced market-data feeds."""
