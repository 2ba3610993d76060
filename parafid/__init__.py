"""Parafid: Spark-native analysis of how faithfully one text restates another."""
