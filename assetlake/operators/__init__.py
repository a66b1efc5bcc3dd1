"""DataFrame operators: joins, aggregations, rule resolution, ordering, sets and pixel grids."""
