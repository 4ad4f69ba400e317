"""Registered query plans: each Spark query sits next to its oracle SQL."""

from .common import REGISTRY


def load_all():
    """Import every plan module so its queries register."""
    from . import control, ensembles, evaluation, learning, lifecycle, models, relational, streaming, tuning  # noqa: F401
    return REGISTRY
