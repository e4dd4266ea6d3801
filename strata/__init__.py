"""Strata: hybrid text + vector retrieval and context building as Spark DataFrame jobs.

Every operator takes DataFrames (a table of documents, a table of queries, a
table of hits) and returns a DataFrame; a single query is a one-row table.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
