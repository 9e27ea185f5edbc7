"""Document retrieval, memory and knowledge-graph operators as Spark plans."""
