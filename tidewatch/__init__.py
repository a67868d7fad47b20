"""Spark-native user-behaviour analytics: alerts -> events -> sessions -> scores -> alerts."""
