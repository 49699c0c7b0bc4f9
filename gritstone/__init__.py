"""Spark-native analytics of disclosure text: composable DataFrame operators and their queries."""
