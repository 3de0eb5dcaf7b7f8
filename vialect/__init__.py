"""vialect: a PySpark-native engine for grouping variant place names and for preparing training text."""
