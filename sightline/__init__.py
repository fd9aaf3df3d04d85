"""Security-findings analytics on Spark: scanner exports in, ranked report tables out.

Every operator is a function from DataFrame(s) to DataFrame(s).  One plan covers
every run of every client: ``run_id`` is an ordinary column.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
