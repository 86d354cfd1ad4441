"""What can be wrong with a file; the class name becomes the error_class column."""


class DecodeError(ValueError):
    """A file or stream that can't be decoded."""


class NotContainer(DecodeError):
    """Not a compound file."""


class Corrupt(DecodeError):
    """Damaged beyond what is read leniently."""


class Unsupported(DecodeError):
    """A known but unhandled layout."""


class TooLarge(DecodeError):
    """A limit was reached."""
