"""hourbook: work-log analytics on Spark.

Raw issue-tracker exports (change feed, worklog entries, issue snapshots)
become two tables, ``worklog`` and ``issue``; fixed reports run over them as
DataFrame plans.
"""

__version__ = "0.1.0"
