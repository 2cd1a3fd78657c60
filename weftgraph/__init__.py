"""weftgraph: a PySpark-native engine for typed program graphs and the text around them."""
