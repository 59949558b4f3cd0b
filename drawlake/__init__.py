"""drawlake: a Spark-first engine for drawing-extraction analytics."""
