"""Registered queries; importing this package fills the registry."""

from . import external, features, gating, jobs, metrics, quality, targets  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
