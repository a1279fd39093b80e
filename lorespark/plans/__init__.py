"""The catalogue of named queries and their SQL counterparts."""
