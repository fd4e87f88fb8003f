"""Exceptions of the library. Row-level problems are columns (reject_reason), not exceptions."""


class LineloomError(Exception):
    """Base of all."""


class BadInput(LineloomError):
    """An argument or input that can't be used."""


class BadImage(BadInput):
    """Not an image of the kind asked for."""


class BadClassLabel(BadInput):
    """Not a class label."""


class RecognitionError(LineloomError):
    """A model can't be applied to its input."""


class CheckFailed(BadInput):
    """A rule of validate() that must hold doesn't."""
