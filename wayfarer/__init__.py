"""Mobility analytics and training-data operators on Spark."""

from __future__ import annotations

__version__ = "0.2.0"


def print_version() -> None:
    """Prints the versions of this library and of what it stands on."""
    import platform

    import numpy
    import pyarrow
    import pyspark

    for name, version in (("wayfarer", __version__), ("python", platform.python_version()), ("pyspark", pyspark.__version__), ("pyarrow", pyarrow.__version__), ("numpy", numpy.__version__)):
        print(f"{name:10} {version}")
