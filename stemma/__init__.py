"""stemma: bulk text comparison on PySpark.

Functions of this package travel to the workers by value, so a cluster needs
no installed copy of it and a driver may import it from any folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
