"""lexforge: a Spark-native analytics engine for regulation and compliance documents."""
