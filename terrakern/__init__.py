"""terrakern: ground-investigation analytics expressed as Spark DataFrame jobs."""
