"""Training-data operators at corpus scale, each one usable on its own.

Nothing outside this subpackage imports it.  The kernels run in Arrow batches
on the executors; they are pickled by value so that executors need no copy of
the package on their import path.
"""

import quiverlake
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(quiverlake)
