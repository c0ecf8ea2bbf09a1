"""thalweg: drainage-basin analytics and bulk data preparation on Apache Spark.

Everything is a function from DataFrames to a DataFrame: the logical plan is declared with built-in
expressions, Catalyst picks the physical strategy, and Arrow kernels appear only where no expression exists.
"""

from thalweg.config import Settings

__all__ = ["Settings"]
__version__ = "0.1.0"
