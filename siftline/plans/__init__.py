"""Queries by name; importing the package registers all of them."""

from . import bindings, lookups, sources, state, workflow  # noqa: F401
