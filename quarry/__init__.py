"""A Spark-native engine for sharded key/value jobs, features and L1 logistic regression."""
