"""A Spark-first engine for order and star-schema analytics and single-operator workloads."""
