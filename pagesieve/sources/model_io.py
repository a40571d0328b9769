"""Model file I/O (S8, S9) and its relational views.

The exported model is one JSON object: ``W_num`` (12 x 2), ``bias`` (2),
``U`` (n-gram -> 2 floats), ``mu`` and ``sigma`` (1 x 12). It is read with an
explicit schema (``U`` is a map; inference would make it a struct) and exposed
as small DataFrames.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

SHIPPED_MODEL = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources",
                             "shipped_model.json")

MODEL_SCHEMA = T.StructType([
    T.StructField("W_num", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("bias", T.ArrayType(T.DoubleType())),
    T.StructField("U", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
    T.StructField("mu", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("sigma", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


@dataclass
class CollapsedModel:
    """The small collapsed model: per-gram 2-vectors plus a linear numeric part."""

    w_num: list[list[float]]
    bias: list[float]
    u: dict[str, list[float]]
    mu: list[float]
    sigma: list[float]
    num_columns: list[str] = field(default_factory=lambda: list(K.NUM_COLUMNS))

    @property
    def gram_lengths(self) -> list[int]:
        return sorted({len(g) for g in self.u})

    def to_json(self) -> str:
        return json.dumps({"W_num": self.w_num, "bias": self.bias, "U": self.u,
                           "mu": [self.mu], "sigma": [self.sigma]})

    @staticmethod
    def from_dict(d: dict) -> CollapsedModel:
        def flat(x):
            return list(x[0]) if x and isinstance(x[0], (list, tuple)) else list(x)
        return CollapsedModel(
            w_num=[list(r) for r in d["W_num"]], bias=list(d["bias"]),
            u={k: list(v) for k, v in dict(d["U"]).items()},
            mu=flat(d["mu"]), sigma=flat(d["sigma"]))


def read_model_df(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The model file as a one-row DataFrame with an explicit schema."""
    if path is None:
        with open(SHIPPED_MODEL, encoding="utf-8") as f:
            d = json.load(f)
        return spark.createDataFrame([(d["W_num"], d["bias"], d["U"], d["mu"], d["sigma"])],
                                     MODEL_SCHEMA)
    return spark.read.schema(MODEL_SCHEMA).option("multiLine", True).json(path)


def load_model(spark: SparkSession, path: str | None = None) -> CollapsedModel:
    """The model as driver-side literals (one row, size checked)."""
    df = read_model_df(spark, path)
    n = df.select(F.size("U").alias("n")).first()
    if n is None:
        raise ValueError("empty model file")
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a model file holds exactly one JSON object")
    r = rows[0].asDict(recursive=True)
    return CollapsedModel.from_dict(r)


def gram_table(spark: SparkSession, model: CollapsedModel) -> DataFrame:
    """``(ngram, u0, u1)`` of the kept n-grams."""
    rows = [(g, float(v[0]), float(v[1])) for g, v in sorted(model.u.items())]
    return spark.createDataFrame(rows, "ngram string, u0 double, u1 double")


def numeric_table(spark: SparkSession, model: CollapsedModel) -> DataFrame:
    """``(pos, feature, w0, w1, mu, sigma)`` in the model's column order."""
    rows = [(i, c, float(model.w_num[i][0]), float(model.w_num[i][1]),
             float(model.mu[i]), float(model.sigma[i]))
            for i, c in enumerate(model.num_columns)]
    return spark.createDataFrame(rows, "pos int, feature string, w0 double, w1 double, "
                                       "mu double, sigma double")


def model_relations(spark: SparkSession, path: str | None = None) -> dict[str, DataFrame]:
    """S8 as relations, all derived in Spark from the one-row model DataFrame."""
    df = read_model_df(spark, path)
    grams = df.select(F.explode("U").alias("ngram", "u")).select(
        "ngram", F.col("u")[0].alias("u0"), F.col("u")[1].alias("u1"))
    names = F.array(*[F.lit(c) for c in K.NUM_COLUMNS])
    numeric = df.select(F.posexplode("W_num").alias("pos", "w"), "mu", "sigma").select(
        "pos", F.element_at(names, F.col("pos") + 1).alias("feature"),
        F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"),
        F.col("mu")[0][F.col("pos")].alias("mu"), F.col("sigma")[0][F.col("pos")].alias("sigma"))
    bias = df.select(F.col("bias")[0].alias("b0"), F.col("bias")[1].alias("b1"))
    return {"grams": grams, "numeric": numeric, "bias": bias}


def write_model(model: CollapsedModel, spark: SparkSession, path: str) -> None:
    """Export the model as one JSON object (a single small file)."""
    df = spark.createDataFrame(
        [(model.w_num, model.bias, model.u, [model.mu], [model.sigma])], MODEL_SCHEMA)
    df.coalesce(1).write.mode("overwrite").json(path)
