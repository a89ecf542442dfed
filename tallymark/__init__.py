"""Score extracted structured data against ground truth, as Spark DataFrame jobs."""
