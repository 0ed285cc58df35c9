"""Vector, sampling and cluster analytics as lazy PySpark DataFrame operators."""
