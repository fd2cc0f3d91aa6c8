"""The superstep loop and the algorithms declared on it."""
