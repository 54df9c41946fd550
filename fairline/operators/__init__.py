"""DataFrame to DataFrame operators: joins, ordering, ranking, aggregation."""
