"""DataFrame operators: evaluation, graph, retrieval, sampling, relational helpers, model steps."""
