"""Configuration-driven ingestion and promotion on Spark."""
