"""A bounded sample of texts to train on, the same for the same rows whatever their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The hash limit is set for this many times the rows wanted, so that chance seldom leaves too few.
MARGIN = 1.5


def hash_sample(texts: DataFrame, key: str, text: str, rows: int, chars: int) -> list[str]:
    """At most ``rows`` non-empty texts, those with the smallest hash of their key; of a text above ``chars`` characters a
    stretch of that length, at a place picked by hash.

    Rows are counted first (without reading the texts), which gives a limit for the hash; then the texts below it are
    read in one pass. What the driver gets is bounded by ``rows`` times ``chars``."""
    keyed = texts.where(F.col(key).isNotNull())
    share = min(1.0, MARGIN * rows / max(keyed.select(key).count(), 1))
    lot = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
    place = F.pmod(F.xxhash64(F.lit("place"), key), F.greatest(F.length(text) - chars, F.lit(0)) + 1) + 1
    some = keyed.where((lot <= share) & (F.length(text) > 0)).select(lot.alias("lot"), key, F.substring(F.col(text), place.cast("int"), F.lit(chars)).alias(text))
    return [r[text] for r in some.orderBy("lot", key, text).limit(rows).collect()]
