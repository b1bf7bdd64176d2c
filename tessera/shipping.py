"""Worker functions travel with the task, so executors need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """What worker functions use of the module is pickled by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
