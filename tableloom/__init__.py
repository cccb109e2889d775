"""tableloom: from several raw business tables to one modelling table and on to answers, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions run inside Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tableloom.session import build_session, configure  # noqa: E402

__all__ = ["build_session", "configure"]
