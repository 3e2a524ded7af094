"""Parley: conversation-data preparation on Spark."""
