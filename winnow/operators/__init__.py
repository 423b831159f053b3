"""DataFrame operators: scoring, gates, joins, aggregates, ranking, sets and checks."""
