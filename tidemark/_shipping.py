"""How the package's Python functions reach the executors."""

from __future__ import annotations

import importlib

from pyspark import cloudpickle


def ship(package: str) -> None:
    """Pickle functions of ``package`` by value, so executors need no copy of the code on their path."""
    cloudpickle.register_pickle_by_value(importlib.import_module(package))
