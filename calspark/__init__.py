"""A PySpark-native analytics engine for imaging movies and the traces taken from them."""
