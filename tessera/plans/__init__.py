"""Complete queries with their parameters and SQL counterparts."""
