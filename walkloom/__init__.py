"""walkloom: graph walks, searches and their features as Spark DataFrame jobs."""
