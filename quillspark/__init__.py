"""quillspark: corpus preparation, instruction data, token streams and
benchmark scoring expressed as Spark DataFrame jobs.

Every public operator takes DataFrames (and plain parameters) and returns a
DataFrame; nothing is collected to the driver except tiny size checks.
"""

__version__ = "0.1.0"
