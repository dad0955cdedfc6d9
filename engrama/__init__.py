"""Semantic-memory analytics on Spark: vector trees, episodic logs, telemetry and graph operators over DataFrames."""
