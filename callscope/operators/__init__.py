"""DataFrame in, DataFrame out. No operator here runs a Spark action."""
