"""Training-data operators: one module per operator, registered as queries in ``queries``."""

from pyspark import cloudpickle

from tessera import llm as _self

# Functions of this subpackage travel to the executors by value, so a cluster needs no copy of the repository.
cloudpickle.register_pickle_by_value(_self)
