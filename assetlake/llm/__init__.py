"""Training-data operators: one module for each, plus their queries and oracle SQL."""
import sys

from pyspark import cloudpickle

# functions of this package travel with the job, so that executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
