"""Spark-native terrain, reachability and ranking engine."""
