"""platewise: daily demand forecasting and forecast analysis on Spark.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark's own expressions. Operators take ``keys``
(default ``["date"]``, ``["site_id", "date"]`` for many sites) so the same
code serves one canteen or thousands of them.
"""

from platewise.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
