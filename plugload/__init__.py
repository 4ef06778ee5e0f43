"""Smart-plug load analytics on PySpark: load prediction and outlier shares, batch and streaming."""

import sys

from pyspark import cloudpickle

from plugload.settings import Settings

# Functions of this package travel to the executors by value, so the package need only be installed on the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
