"""A Spark-first engine for preparing large machine-learning datasets."""
