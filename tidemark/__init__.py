"""Text-sentiment and volatility analytics as Spark DataFrame jobs."""
