"""Operators for preparing training corpora: scoring, deduplication, language ID,
packing, filtering, mixing, archives and secret scanning.

Nothing outside this subpackage imports it. Its functions travel to Python workers by value, so
executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
