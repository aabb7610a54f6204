"""What sources raise."""


class Unsupported(ValueError):
    """A format, or a kind of it, that is not part of this engine."""
