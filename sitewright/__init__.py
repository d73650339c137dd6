"""Website text analytics expressed as Spark DataFrame jobs."""
