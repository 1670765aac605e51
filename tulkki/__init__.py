"""tulkki: corpus-scale speech-recognition and translation quality evaluation on Spark.

Everything is DataFrame work: text normalisation and splitting are JVM
expressions, pairs of texts are scored in one Arrow-batched pandas UDF,
reports are partial aggregates.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's UDF code by value so executors need no install.

    On a cluster the package may also be shipped with ``--py-files``; by-value
    pickling keeps the UDFs working either way.
    """
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
