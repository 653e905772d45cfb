"""Imports every module that registers queries."""

from skysieve.checks import clusters, flows, pixels, signal, survey, tracks  # noqa: F401
from skysieve.checks.registry import QUERIES, oracles  # noqa: F401
