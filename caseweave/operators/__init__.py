"""DataFrame operators: filters, joins, aggregates, windows, extraction, graph, lifecycle."""
