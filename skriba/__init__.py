"""skriba: Spark-native text normalisation and lexicon building.

Column functions live in ``functions``, table operators in ``operators``, readers
and writers in ``sources``, end-to-end dataflows in ``plans`` and incremental
wrappers in ``streaming``.
"""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so a session that
# was started elsewhere needs no installation on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
