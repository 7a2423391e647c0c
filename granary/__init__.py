"""A PySpark-native analytics engine for receipts, ingredients, recipes and text corpora."""
