"""What can go wrong with catalogs, logs, units and scans."""


class TidelogError(Exception):
    """Base of all errors of this package."""


class CatalogError(TidelogError):
    """A catalog operation failed."""


class AlreadyExists(CatalogError):
    pass


class NotFound(CatalogError):
    pass


class VersionConflict(CatalogError):
    def __init__(self, name: str, expected: int, actual: int):
        super().__init__(f"{name}: expected version {expected}, found {actual}")
        self.expected, self.actual = expected, actual


class InvalidOptions(CatalogError):
    pass


class LogError(TidelogError):
    """A timeline operation failed."""


class Fenced(LogError):
    """A newer term holds the timeline."""

    def __init__(self, current: int):
        super().__init__(f"fenced by term {current}")
        self.current = current


class InvalidTerm(Fenced):
    """A write of an older term."""


class ReadOnly(LogError):
    pass


class InvalidArgument(LogError):
    pass


class NotEnoughUnits(LogError):
    pass


class Cancelled(LogError):
    """An event that was still waiting when its writer was closed."""


class ScanError(TidelogError):
    """A dataset scan names an unknown field or operation."""


class CodecError(TidelogError):
    """A physical record is short, of unknown type or damaged."""
