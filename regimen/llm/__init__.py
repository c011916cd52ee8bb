"""Training-data pipeline operators.

One module per operator; nothing else in the library imports this
subpackage.  Task-side helpers are shipped to executors by value, so workers
need no installation of the library.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
