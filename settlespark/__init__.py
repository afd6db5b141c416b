"""Half-hourly market analytics as Spark DataFrame operators and jobs."""
