"""Event-time windows and the queries that write them."""
