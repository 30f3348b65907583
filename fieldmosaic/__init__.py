"""Field samples and gridded satellite products as Spark DataFrames.

Every operator is a plain function from DataFrames (plus keyword parameters) to
a DataFrame. Missing values are SQL NULL everywhere: readers turn NaN and
infinities into NULL, and no later operator has to care about them.
"""

from .session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
