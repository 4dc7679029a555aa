"""tillroll: retail sales analytics as Spark DataFrame operators.

Every public operator takes a DataFrame (plus plain parameters) and returns a
DataFrame.  Nothing is collected to the driver except results with a proven
small bound: the two IQR fences, quantile bin edges (q+1 values), the top-N
basket items (N rows) and the pivot's period list (one value per month).  Other one-row statistics stay in
the plan as broadcast relations.
"""

from tillroll.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
