"""The model list as a small frame."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalogue import catalogue
from ..operators.prompts import MODELS
from ..schemas import MODELS as SCHEMA
from .client import WAIT_S, Client, run_one


def list_models(spark: SparkSession, client: Client, wait: float = WAIT_S) -> DataFrame:
    """The provider's usable models in order, with names; an API error raises."""
    got = run_one(client, MODELS, None, wait)
    if got["error"]:
        raise RuntimeError(got["error"]["message"])
    data = json.loads(got["response"]).get("data") or []
    rows = [(m["id"], m.get("owned_by")) for m in ([data] if isinstance(data, dict) else data)]
    return catalogue(spark.createDataFrame(rows, SCHEMA))
