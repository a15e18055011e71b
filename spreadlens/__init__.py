"""spreadlens: Spark-native propagation analytics (graph features, exact retrieval, balanced exemplars,
batch scoring, evaluation over parameter grids)."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions this package hands to Spark (pandas UDF bodies, the scoring map, test doubles) are pickled by value,
# so executors run them without the package being installed on their Python path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
