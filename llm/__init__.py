"""Operations of a large training-data pipeline, one module per operator.

Nothing outside this subpackage imports it; ``queries.py`` registers one thin
query per operator and ``corpus_pipeline.py`` at the repository top chains five
of them.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster needs
# no copy of the package on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
