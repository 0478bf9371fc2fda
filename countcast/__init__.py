"""Count analytics and forecasting on Spark DataFrames.

A *fact* table is a set of categorical dimensions plus one non-negative count.
Every function takes and returns DataFrames; nothing collects fact rows.
"""

from countcast.spec import CELLS, HEADCOUNT, CountSpec

__all__ = ["CELLS", "HEADCOUNT", "CountSpec"]
