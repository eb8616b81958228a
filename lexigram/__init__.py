"""PySpark-native n-gram tables over text corpora: build, store, search."""
