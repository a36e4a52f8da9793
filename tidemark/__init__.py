"""tidemark: an analytics engine expressed as Spark plans."""
