"""DataFrame operators: unnesting, projections, routing, request checks."""
