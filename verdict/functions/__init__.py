"""Column -> Column building blocks. Built-in Spark functions only."""

from . import ids, labels, payloads, templates, text  # noqa: F401
