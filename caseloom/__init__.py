"""Caseloom: Spark-native analytics over case documents, pages, events and vectors."""
