"""DataFrame operators: chunks, retrieval, memory, graph, context, imports, history, evaluation."""
