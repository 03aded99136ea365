"""tesselar: tensor checkpoint analytics expressed as Spark DataFrame jobs."""
