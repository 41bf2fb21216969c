"""Operators for preparing training text.

Nothing outside this package imports it. Functions that run in Spark's Python
workers travel by value, so executors need the public libraries but not this
package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
