"""Financial-event ingestion, state and analytics on Spark DataFrames."""
