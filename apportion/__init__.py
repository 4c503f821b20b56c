"""Apportion: study how rows and streams divide over workers, on Spark.

The package is organised the way a job is written:

``sources``    read tables and result files with declared schemas, write results
``functions``  column expressions shared by every operator
``operators``  DataFrame -> DataFrame building blocks
``plans``      whole analyses assembled from operators
``streaming``  the same analyses over Structured Streaming
"""

__version__ = "0.1.0"
