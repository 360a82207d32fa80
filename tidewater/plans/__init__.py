"""Query catalog.  Importing this package registers every query."""

from . import q_artifacts, q_datasets, q_files, q_logs, q_signals, q_specs, q_streaming, q_telemetry  # noqa: F401
from .registry import INVENTORY_ID, ORACLES, QUERIES  # noqa: F401
