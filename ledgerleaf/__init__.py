"""Spark-native processing of loan-document collections: scan, de-duplicate, parse, merge, map to forms, reconcile."""
