"""Token-usage analytics for AI coding agents as Spark DataFrame jobs."""
