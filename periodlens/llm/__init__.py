"""Training-data operators: ten operators over documents, pages, conversations
and benchmark items, and the queries that apply them to whole tables.

Nothing else in the library imports this package. Functions that run in
executors' Python are pickled by value, so that a cluster needs no copy of the
package on its workers."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
