"""statgate: data-quality checks for statistical observation datasets on Spark.

Every operator takes and returns DataFrames; ``dataset_id`` is the implicit
leading key so one job validates many datasets at once.
"""

__version__ = "0.1.0"
