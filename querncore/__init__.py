"""querncore: a PySpark-native engine for asset evaluation tables and training-data pipelines."""
