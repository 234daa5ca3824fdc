"""weft: graph-learning analytics expressed as Spark DataFrame plans."""
