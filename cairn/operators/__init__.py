"""DataFrame operators: search, joins, aggregation, maintenance."""
