"""Queries composed of the operators, each with its SQL."""

from . import audits, evaluations, exports, sequences  # noqa: F401 - they fill the catalogue
