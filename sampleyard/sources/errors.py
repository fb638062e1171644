"""Errors with the exit codes of the command line."""


class SampleyardError(Exception):
    exit_code = 1


class BadInputError(SampleyardError):
    """The caller asked for something that cannot be."""

    exit_code = 1


class BackendError(SampleyardError):
    """A recogniser is not available or failed."""

    exit_code = 3
