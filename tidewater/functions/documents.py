"""Documents that are JSON or YAML, as variants."""

from __future__ import annotations

import json
import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors get this module's code with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Values a YAML document may unfold to per character of its text, and a head start.
UNFOLD, LEAST = 4, 1000


def _plain(value, left: list[int], depth: int = 0):
    """``value`` as JSON knows it: keys are texts, numbers that JSON lacks (and dates) too."""
    left[0] -= 1
    if left[0] < 0 or depth > 200:
        raise ValueError("a document that unfolds without end")
    if isinstance(value, dict):
        return {json.dumps(k) if k is None or isinstance(k, (bool, int, float)) else str(k): _plain(v, left, depth + 1) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v, left, depth + 1) for v in value]
    if value is None or isinstance(value, (str, bool, int)) or isinstance(value, float) and math.isfinite(value):
        return value
    return value.decode("latin-1") if isinstance(value, bytes) else str(value)


def _yaml_as_json(text: str | None) -> str | None:
    """JSON text of a YAML document; null for an empty or malformed one, or one whose
    references unfold to itself or far beyond its own length."""
    import yaml

    if not text:
        return None
    try:
        found = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        return None if found is None else json.dumps(_plain(found, [UNFOLD * len(text) + LEAST]), allow_nan=False)
    except (yaml.YAMLError, ValueError, TypeError, RecursionError, OverflowError):
        return None


@F.pandas_udf(T.StringType())
def _load(texts: pd.Series) -> pd.Series:
    return texts.map(_yaml_as_json, na_action="ignore")


def parse_document(text: Column) -> Column:
    """The document as a variant, null if it is empty or malformed.  JSON is parsed by Spark;
    only what isn't JSON goes through the YAML loader, an Arrow batch at a time."""
    native = F.try_parse_json(text)
    return F.coalesce(native, F.try_parse_json(_load(F.when(native.isNull(), text))))


def with_document(df: DataFrame, text: str, out: str = "doc") -> DataFrame:
    """``df`` with the document of column ``text`` as ``out``.  Every parse stands behind a Generate
    (``inline`` of one element), so that neither a filter nor several uses of ``out`` parse it
    again, and JSON is parsed once for its document and for the test whether it is JSON."""
    native = df.select("*", F.inline(F.array(F.struct(F.try_parse_json(F.col(text)).alias("_native")))))
    loaded = native.withColumn("_json", _load(F.when(F.col("_native").isNull(), F.col(text))))
    return loaded.select(*df.columns, F.inline(F.array(F.struct(F.coalesce("_native", F.try_parse_json("_json")).alias(out)))))


def with_document_if_used(df: DataFrame, text: str, out: str = "doc") -> DataFrame:
    """``with_document`` for rows that no filter on the document follows: a chain of projections, which
    Spark drops where ``out`` is not used.  Each parse is used more than once by the next step,
    so none is folded into it and done again."""
    native = df.withColumn("_native", F.try_parse_json(F.col(text)))
    loaded = native.withColumn("_json", _load(F.when(F.col("_native").isNull(), F.col(text))))
    return loaded.select(*df.columns, F.coalesce("_native", F.try_parse_json("_json")).alias(out))
