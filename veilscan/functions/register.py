"""SQL names for the engine's functions: scalar UDFs over Arrow batches and a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codec, document


RESULT = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("severity", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("decoded", T.StringType())])
#: Scalar functions by SQL name: what they return and how they read one text.
SCALARS = {
    "hidden_severity": (T.IntegerType(), lambda t: document.Reading(t).severity),
    "visible_text": (T.StringType(), lambda t: document.Reading(t).visible_text),
    "human_text": (T.StringType(), lambda t: document.Reading(t).human_text),
    "sanitize_text": (T.StringType(), lambda t: document.sanitize(t)["text"]),
    **{f"encode_{scheme.replace('-', '_')}": (T.StringType(), lambda t, encode=encode: None if t is None else encode(t)) for scheme, encode in codec.SCHEMES.items()},
}


def scalar(name: str):
    """One of SCALARS as a pandas UDF."""
    kind, read = SCALARS[name]

    def udf(text: pd.Series) -> pd.Series:
        return text.map(read)

    return F.pandas_udf(udf, kind)


class HiddenFindings:
    """``SELECT * FROM hidden_findings(text)``, or LATERAL over a table."""

    def eval(self, text: str):
        for rank, f in enumerate(document.Reading(text).findings):
            yield rank, f.id, f.severity, f.count, f.decoded


def register(spark: SparkSession) -> None:
    for name in SCALARS:
        spark.udf.register(name, scalar(name))
    spark.udtf.register("hidden_findings", F.udtf(HiddenFindings, returnType=RESULT))
