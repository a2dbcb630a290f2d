"""Errors that the engine raises before or instead of running a plan."""


class EngineError(Exception):
    """Any error of this package."""


class QueryError(EngineError):
    """A query that can't be planned: wrong types, unknown operators, wrong combinations."""


class MissingColumnError(QueryError):
    def __init__(self, name: str):
        super().__init__(f"Missing column: {name}")
        self.name = name


class EmptyInputError(QueryError):
    def __init__(self):
        super().__init__("Cannot aggregate empty values")


class LoadError(EngineError):
    """A file that can't be taken as a table."""
