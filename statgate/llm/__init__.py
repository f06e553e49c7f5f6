"""Training-data operators for large text corpora.

One module per operator; ``queries.py`` registers one query per operator and
its DuckDB oracle where SQL can express it. Nothing outside this folder (and
``corpus_pipeline.py``) imports it.

Functions that run inside Spark tasks are pickled by value, so executors need
numpy, pyarrow and xxhash but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
