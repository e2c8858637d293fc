"""doorstep: Spark jobs over local-business records.

Every operator takes DataFrames (or Columns) and returns a DataFrame (or a Column).
"""

from doorstep.session import build_session, prepare

__all__ = ["build_session", "prepare"]
