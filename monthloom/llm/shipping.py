"""Makes this package importable in the Python workers of a session."""

from monthloom.shipping import ship  # noqa: F401
