"""tessera: a PySpark-native engine for text, graph, relational and stream analytics.

Every operator is a plain function from DataFrames to a DataFrame; nothing runs until the caller acts.
"""
