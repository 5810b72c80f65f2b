"""Spark-native building, searching and measuring of document collections."""
