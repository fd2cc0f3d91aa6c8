"""Column functions that Spark lacks; all are built-in expressions."""
