"""All named queries."""

from lotwise.plans import cleaning, gaussian_process, grouped_processes, latent_factors, profiling, regression  # noqa: F401
from lotwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
