"""A PySpark-native engine for building, searching and evaluating language-model datasets."""
