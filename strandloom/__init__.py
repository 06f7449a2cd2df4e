"""Spark-native analytics for labelled long-read signals and genome intervals."""
