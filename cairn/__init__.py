"""cairn: a PySpark-native engine for mining wide cohort tables."""
