"""Queries of the boosted hierarchy over embeddings as windows. Boosted trees are not SQL, so they have no oracle; a test holds them to a plain booster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.functions.arrays import FEATURES
from rillwave.functions.ordering import materialise
from rillwave.operators import models as B

from .signals import feature_table


def gbt_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Trained on patients that do not divide by 4, scored on the others."""
    t = materialise(feature_table(spark, d), "features")
    model = B.fit_hierarchy(t.where("patient % 4 <> 0"), list(FEATURES), "label")
    return B.route(model.predict(t.where("patient % 4 = 0")), 0.5, 0.5).select("vec_id", "patient", "label", "p_alarm", "p_ictal", "pred", "q0", "q1", "q2")


def nested_cv(spark: SparkSession, d: str) -> DataFrame:
    """Five outer folds of patients, each row scored once by models that never saw its patient."""
    t = materialise(feature_table(spark, d).withColumn("fold", (F.col("patient") % 5).cast("int")), "features")
    return B.nested_cv(t, list(FEATURES), "label", "patient", "fold", list(range(5))).select("vec_id", "patient", "label", "outer_fold", "t1", "t2", "p_alarm", "p_ictal", "pred")


QUERIES = {f.__name__: f for f in (gbt_hierarchy, nested_cv)}
ORACLES: dict[str, str] = {}
