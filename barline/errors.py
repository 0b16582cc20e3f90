"""Errors raised while a plan is built; data never has to be read to see them."""


class BarlineError(ValueError):
    """Base of all errors of this library."""


class InvalidWindow(BarlineError):
    """A window that is not a positive whole number."""


class InvalidParameter(BarlineError):
    """A parameter outside its range."""


class MissingColumn(BarlineError):
    """A column that a table does not have."""


class DuplicateColumn(BarlineError):
    """A column that a table has already."""


class NotFitted(BarlineError):
    """A transform used before it was fitted."""


class InverseNotSupported(BarlineError):
    """A transform that cannot be undone."""


class StateVersionError(BarlineError):
    """A saved state of another version."""


def window(n: int, name: str = "window") -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n <= 0:
        raise InvalidWindow(f"{name} must be a positive whole number, not {n!r}")
    return n


def columns(df, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumn(", ".join(missing))
