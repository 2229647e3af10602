"""Every registered query."""
from checks import evaluation, features, intake, modelling  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
