"""Spark-native analytics for keyed market series: bars, labels, weights, features, validation, evaluation, allocation."""
