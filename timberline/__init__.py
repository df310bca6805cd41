"""timberline: log analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from timberline.schema import EVENT_SCHEMA, LogSchema
from timberline.session import build_session, prepare

__all__ = ["EVENT_SCHEMA", "LogSchema", "build_session", "prepare"]

# The few Python functions that run in tasks travel with the job, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
