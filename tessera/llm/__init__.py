"""Operators for preparing training corpora.

Nothing else in the library imports this package.  Python functions of this
package are shipped to executors by value, so that executors need no copy of
the repository on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
