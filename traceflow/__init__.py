"""traceflow: Spark operators for logs of learners' question attempts."""

__version__ = "0.1.0"
