"""A Spark-native engine for cleaning and analysing vehicle trajectories."""
