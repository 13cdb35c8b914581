"""gleanery: review analytics as DataFrame-to-DataFrame operators on Spark."""
