"""labelbench: multi-label dataset preparation and evaluation as Spark jobs.

Every function maps DataFrames to DataFrames with native Spark expressions; nothing
runs an action except the explicit sinks and the Spark ML fits.
"""
from .config import ExperimentConfig  # noqa: F401
from .constants import LABELS, EXPERIMENTS, THRESHOLD  # noqa: F401
