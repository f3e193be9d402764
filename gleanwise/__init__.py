"""gleanwise: a PySpark-native engine for judging how far retrieved information can be believed."""
