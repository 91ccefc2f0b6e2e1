"""Analytics on archives of AI-agent sessions, written for PySpark."""
