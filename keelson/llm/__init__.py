"""Training-data operators: language identification, chat formatting, vector search, mixing, deduplication, token counts, quality,
decontamination and language-model scoring. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions of this subpackage travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
