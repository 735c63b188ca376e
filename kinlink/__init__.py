"""kinlink: a Spark-native engine for linking noisy records across sources."""
