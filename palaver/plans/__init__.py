"""The registered queries: views over the given tables, Spark plans and their SQL counterparts."""
