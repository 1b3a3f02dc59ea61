"""Errors with a meaning of their own; all derive from ``RecordingError``."""


class RecordingError(Exception):
    """Base of this package's errors."""


class UnsupportedFormatError(RecordingError):
    """The data is of a layout that isn't accepted; it is refused rather than guessed."""


class DataIntegrityError(RecordingError):
    """The data contradicts itself."""


class ResourceLimitError(RecordingError):
    """A budget is exceeded; the data may be sound."""
