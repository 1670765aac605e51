"""Quality metrics on the counts of aligned pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def wer(counts) -> Column:
    """M2: (S + D + I) / (H + S + D); NULL when the reference has no words."""
    a = _c(counts)
    n_ref = a["hits"] + a["subs"] + a["dels"]
    return F.when(n_ref > 0, (a["subs"] + a["dels"] + a["ins"]) / n_ref)


def wil(counts) -> Column:
    """M3: 1 - H^2 / (N_ref * N_hyp); an empty hypothesis gives 1."""
    a = _c(counts)
    n_ref = a["hits"] + a["subs"] + a["dels"]
    n_hyp = a["hits"] + a["subs"] + a["ins"]
    return F.when(n_ref > 0, F.when(n_hyp == 0, F.lit(1.0))
                  .otherwise(1.0 - (a["hits"] / n_ref) * (a["hits"] / n_hyp)))


# --- fixed values of METEOR (published defaults) ----------------------------
METEOR_ALPHA = 0.9
METEOR_BETA = 3.0
METEOR_GAMMA = 0.5
# ---------------------------------------------------------------------------
