"""Training-data pipeline operators (mixing, filtering, near-duplicates, packing,
sharding, scoring).  Nothing else in the library imports this subpackage.

``QUERIES`` and ``ORACLES`` hold the thin contract queries; each operator module
keeps its own general interface.
"""

import sys

from pyspark import cloudpickle

# Task code travels with the job instead of being imported from a path on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .queries import ORACLES, QUERIES  # noqa: E402,F401
