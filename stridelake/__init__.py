"""Spark-native engine for signals that were cut into sliding windows."""

__all__ = ["__version__"]
__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Let Python workers run this package's functions even where the package itself is not on their path."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
