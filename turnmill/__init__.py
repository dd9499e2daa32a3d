"""turnmill: a PySpark-native engine for timestamped, speaker-labelled text."""
