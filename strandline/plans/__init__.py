"""The query catalogue: one Spark plan and one SQL text per operator."""
