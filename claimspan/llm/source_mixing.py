"""Mixing sources to target weights.

One hash per document orders each source at random. Sums of tokens per source and hash bucket show in which bucket the
source's budget ends; only that bucket is looked into again, with narrower buckets, until the threshold is a single
hash value. Documents are then filtered by comparing their hash with their source's threshold; nothing is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Bits of the hash that one pass resolves: a pass returns at most sources * 2**BITS sums.
BITS = 10
#: All bits that are ever resolved.
HASH_BITS = 60


@dataclass
class _Source:
    budget: float
    passes: int
    #: Documents with a hash below low are in, those at or above high are out.
    low: int = 0
    high: int = 1 << HASH_BITS
    taken: int = 0
    done: bool = False


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens") -> DataFrame:
    """(key, source, n_tokens, repeats): how often each document is used, at least once.

    ``targets`` (source, target_share, max_repeats) is a parameter table of few rows. The mix is made as large as the
    scarcest source allows: total = min over sources with documents of max_repeats * tokens / target_share. A source's
    budget is total * share: whole passes over it, then the documents whose hash is below a threshold once more, up
    to the budget and never above it, so the error is at most one document a source. Sources without target, null
    sources, and documents of null or no size are not used; targets without documents get nothing (see share_report).
    Documents that repeat a key share its hash and are taken together, as long as they fit the budget together.
    """
    rows = sizes.join(F.broadcast(targets.select(source, "max_repeats")), source, "left_semi").where(F.col(size) > 0)
    hashed = cut(rows.select(key, source, size, F.shiftrightunsigned(F.xxhash64(F.lit("mix"), key), 64 - HASH_BITS).alias("h")))
    have = {r[source]: int(r["n"]) for r in hashed.groupBy(source).agg(F.sum(size).alias("n")).collect()}
    wanted = {r[source]: r for r in targets.collect() if have.get(r[source]) and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    empty = "cast(null as bigint)"
    if not wanted:
        return hashed.where("false").select(key, source, size, F.expr(empty).cast("int").alias("repeats"))
    total = min(r["max_repeats"] * have[s] / r["target_share"] for s, r in wanted.items())
    state = {}
    for s, r in wanted.items():
        budget = total * r["target_share"] * (1 + 1e-12)
        passes = min(int(budget // have[s]), int(r["max_repeats"]))
        state[s] = _Source(budget - passes * have[s], passes, done=passes >= int(r["max_repeats"]))
        if state[s].done:
            state[s].high = 0
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        searched = [(s, x.low, x.high) for s, x in state.items() if not x.done]
        if not searched:
            break
        bounds = sizes.sparkSession.createDataFrame(searched, f"{source} string, low bigint, high bigint")
        inside = hashed.join(F.broadcast(bounds), source).where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("high")))
        sums = inside.groupBy(source, F.shiftright("h", shift).alias("bucket")).agg(F.sum(size).alias("n"), F.min("h").alias("least"), F.max("h").alias("most")).collect()
        by_source: dict[str, list] = {}
        for r in sums:
            by_source.setdefault(r[source], []).append((int(r["bucket"]), int(r["n"]), r["least"] == r["most"]))
        for s, _, _ in searched:
            x = state[s]
            for bucket, n, one_hash in sorted(by_source.get(s, [])):
                if x.taken + n <= x.budget:
                    x.taken += n
                    x.low = (bucket + 1) << shift
                    continue
                x.low, x.high = bucket << shift, (bucket + 1) << shift
                x.done = one_hash  # a single document or its repetitions: does not fit, so the threshold is its hash
                break
            else:  # all of it fits
                x.done = True
                x.low = x.high
    cuts = sizes.sparkSession.createDataFrame([(s, x.passes, x.low if x.high else 0) for s, x in state.items()], f"{source} string, passes int, threshold bigint")
    once_more = F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return hashed.join(F.broadcast(cuts), source).select(key, source, size, (F.col("passes") + once_more).cast("int").alias("repeats")).where(F.col("repeats") > 0)


def share_report(mixed: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per target source: documents and tokens used, target share and the share reached of all tokens in the mix."""
    used = mixed.groupBy(source).agg(
        F.count("*").alias("documents"), F.sum(F.col(size) * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    joined = targets.join(used, source, "left").na.fill(0, ["documents", "tokens", "most_repeats"])
    whole = joined.agg(F.sum("tokens").alias("all_tokens"))
    share = F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0)
    return joined.join(F.broadcast(whole)).select(source, "target_share", "max_repeats", "documents", "tokens", "most_repeats", share.alias("actual_share"))
