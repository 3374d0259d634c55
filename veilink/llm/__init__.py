"""Operators for preparing training text: each one a function from DataFrame to DataFrame.

Nothing else in the package imports this folder.  Array kernels travel to the executors with the plan, so the package
need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["veilink"])
