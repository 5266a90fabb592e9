"""All one-vs-rest hinge classifiers with a weight for each class's own rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from idmatch.operators import joint
from idmatch.operators.linear import PASSES, _model_rows


def ova_hinge_fit(df: DataFrame, c: float = 0.001, rounds: int = PASSES, weights: Mapping[int, float] | None = None,
                  label: str = "label", v: str = "v") -> DataFrame:
    """Linear hinge per class with L2 weight ``c``; ``weights`` gives the weight of the positive side per class.

    All classes share each pass over the rows (:func:`joint.joint_fit`); class sets of any size are fitted in groups.
    """
    return _model_rows(df.sparkSession, joint.joint_fit(df, c, weights, rounds, label=label, v=v))
