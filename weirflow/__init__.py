"""Temporal money-flow analytics and training-data operators on Spark."""
