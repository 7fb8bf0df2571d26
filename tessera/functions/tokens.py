"""Arrays of token ids and logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.binding import let


def trim_at_stop(ids: Column, stops: list[int]) -> Column:
    """struct<ids, stopped>: ids up to the first stop id, itself included."""
    places = [F.array_position(ids, s) for s in stops]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    return F.struct(F.when(first.isNotNull(), F.slice(ids, 1, F.coalesce(first, F.lit(1)).cast("int"))).otherwise(ids).alias("ids"), first.isNotNull().alias("stopped"))


def strip_unstopped_end(ids: Column, stopped: Column, end: int) -> Column:
    """Without the last end id and what follows, if generation didn't stop but an end id is there."""
    behind = F.array_position(F.reverse(ids), end)
    cut = F.slice(ids, 1, F.greatest(F.size(ids) - behind, F.lit(0)).cast("int"))
    return F.when(~stopped & (behind > 0), cut).otherwise(ids)


def stop_ids(known: Column, unknown: Column) -> Column:
    """Distinct ids in order, without nulls and the unknown id."""
    return F.array_distinct(F.filter(F.array_compact(known), lambda x: ~x.eqNullSafe(unknown)))


def token_probability(logits: Column, token: Column) -> Column:
    """Softmax probability of a token (an index from 0), by a shift to the largest logit."""
    def softmax(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0).cast("double"), lambda a, x: a + F.exp(x - top))
        return F.exp(F.get(logits, token) - top) / total

    return let(F.array_max(logits), softmax)


def token_rank(logits: Column, token: Column) -> Column:
    """1 plus the number of logits that are strictly larger, so equals share the best rank."""
    return let(F.get(logits, token), lambda own: F.size(F.filter(logits, lambda x: x > own)) + 1)
