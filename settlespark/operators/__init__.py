"""DataFrame operators: point-in-time joins, ordered operators, scoring, risk."""
