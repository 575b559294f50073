"""quarry: a Spark-first engine for byte containers, text rules and ordered series.

Everything is a DataFrame in and a DataFrame out.  Subpackages:

* ``operators`` - interval algebra, series rules, robust statistics, text rules, joins, roll-ups
* ``functions`` - scalar expressions, decoders and numeric kernels
* ``sources``   - files, byte ranges and sidecar tables as DataFrames
* ``plans``     - patch planning, verification, candidate selection
* ``streaming`` - file-arrival and online series queries
"""

__version__ = "0.1.0"
