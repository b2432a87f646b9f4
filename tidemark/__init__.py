"""Vessel-activity and port-risk analytics as Spark DataFrame operators."""
