"""symtide - a PySpark-native analytics engine for the facts of a C++ code index.

Sub-packages: ``sources`` (tables in and out), ``functions`` (column builders and
text rules), ``operators`` (DataFrame -> DataFrame operators), ``streaming``
(Structured Streaming variants), ``plans`` (named queries with their SQL) and the
optional ``llm`` package (text operators; nothing else imports it).
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel by value, so no executor needs this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
