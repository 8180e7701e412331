"""The model catalogue: filter, order, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(models: DataFrame) -> DataFrame:
    """Without the provider's internal models; a missing owner stays."""
    return models.where(~F.col("owned_by").eqNullSafe("openai-dev"))


def order_keys(model_id: Column) -> list[Column]:
    """gpt first; dated ids after others; previews after others; then by the id as a reader sorts it."""
    return [~model_id.rlike("^gpt"), model_id.rlike("-[0-9]{4,}$"), model_id.contains("-preview"), F.collate(model_id, "UNICODE")]


def display_name(model_id: Column) -> Column:
    words = F.transform(F.split(model_id, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    name = F.array_join(words, " ")
    name = F.array_join(F.transform(F.split(name, " "), lambda w: F.when(F.lower(w) == "hd", F.upper(w)).when(w.rlike("^(?i)[0-9]+k$"), F.upper(w)).otherwise(w)), " ")
    name = F.regexp_replace(name, "Dall E", "Dall-E")
    name = F.regexp_replace(name, "^Whisper ", "Whisper-")
    name = F.regexp_replace(name, "([0-9]{4}) ([0-9]{2}) ([0-9]{2})", "$1-$2-$3")
    short = name.rlike("^(?i)(gpt|tts)\\s")
    return F.when(short, F.concat(F.upper(F.substring(name, 1, 3)), F.lit("-"), F.substring(name, 5, 1_000_000))).otherwise(name)


def catalogue(models: DataFrame) -> DataFrame:
    """id, owned_by, name in order; the list is the catalogue of one provider, hence small."""
    return usable(models).orderBy(*order_keys(F.col("id"))).select("id", "owned_by", display_name(F.col("id")).alias("name"))
