"""Search over public exports by overlap of identifier words."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import identifier_tokens


def query_tokens(query: str) -> list[str]:
    split = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query))
    return list(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", split.lower()) if t))


def _overlaps(token: str) -> Callable[[Column], Column]:
    return lambda t: t.contains(token) | F.lit(token).contains(t)


def search(exports: DataFrame, query: str, most: int = 20) -> DataFrame:
    """Exports (module, name) by the share of query words that contain, or are contained in, one of
    their words; best first, a top-k report with the total of all matches."""
    tokens = query_tokens(query)
    words = identifier_tokens(F.col("name"))
    hits = F.lit(0)
    for q in tokens:
        hits = hits + F.exists(words, _overlaps(q)).cast("int")
    out = exports.withColumn("score", hits / F.lit(max(1, len(tokens)))).where("score > 0")
    total = out.agg(F.count("*").alias("total"))
    top = out.orderBy(F.desc("score"), F.collate("module", "UNICODE"), F.collate("name", "UNICODE")).limit(most)
    return top.join(total, F.lit(True))
