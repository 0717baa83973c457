"""Queries on the driver's tables; importing this package registers them."""

from . import catalog, letters, lifecycle, recognition, review, search, structure  # noqa: F401
