"""Errors of dictionary inputs and arguments."""


class InvalidFormat(ValueError):
    """An input line that breaks its file's format."""


class InvalidArgument(ValueError):
    """A parameter outside its range."""
