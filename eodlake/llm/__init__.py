"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; `registry` binds the operators to the test tables as queries.

Functions that run in tasks are sent by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
