"""Container forensics and corpus preparation as Spark dataflows."""
