"""quire — listing-quality analytics as Spark DataFrame operators.

Row-local measures are Catalyst column expressions (``quire.functions``),
table-level work is DataFrame operators (``quire.operators``), inputs and
outputs live in ``quire.sources``, composed feature queries in
``quire.plans`` and streaming helpers in ``quire.streaming``.
"""

from quire.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
