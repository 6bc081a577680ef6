"""sievework: a Spark-native engine for code analysis and labelled-dataset preparation."""
