"""What can be wrong with a graph's files or declarations."""


class GraphError(ValueError):
    """Any of the errors below."""


class FormatError(GraphError):
    """A line that can't be read."""


class DuplicateKey(GraphError):
    """A vertex that is listed twice."""


class OutOfRange(GraphError):
    """A tile or vertex outside what was declared."""


class NotFound(GraphError):
    """An edge whose end has no vertex or tile."""


class Frozen(GraphError):
    """A change to a finished graph."""


class NotConverged(GraphError):
    """A run that was to go on until nothing changes and came to its last step before."""
