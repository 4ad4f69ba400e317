"""Training-data operators over documents, pages and benchmark items.

Nothing outside this folder imports it.  Python functions of this subpackage
are shipped to the executors by value, so a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
