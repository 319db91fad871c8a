"""A cache of external calls: exact matches are read, misses go to a client, valid replies are appended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the call's parts as JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def split_by_cache(calls: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``calls`` with ``cached``: whether the cache has the key. One row a call, however often the cache has it."""
    known = cache.select(key).distinct().withColumn("__hit", F.lit(True))
    return calls.join(known, key, "left").withColumn("cached", F.coalesce("__hit", F.lit(False))).drop("__hit")


def answer(calls: DataFrame, cache: DataFrame, key: str, prompt: str, client: Client, valid: Callable[[str], bool], repairs: int = 1) -> DataFrame:
    """Rows (key, reply, cached): replies from the cache, else from the client, asked again ``repairs`` times where invalid; null where none is valid.

    Equal calls are made once. Append the rows with a reply and cached false to the cache.
    """
    todo = calls.select(key, prompt).dropDuplicates([key])
    hits = todo.join(cache.select(key, "reply").dropDuplicates([key]), key).select(key, "reply", F.lit(True).alias("cached"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch[prompt]:
                reply = client(text)
                for _ in range(repairs):
                    if valid(reply):
                        break
                    reply = client(text)
                out.append(reply if valid(reply) else None)
            yield pd.DataFrame({key: batch[key], "reply": out, "cached": False})

    misses = todo.join(cache.select(key).distinct(), key, "left_anti").mapInPandas(ask, f"{key} string, reply string, cached boolean")
    return hits.unionByName(misses)


def second_pass(items: DataFrame, first: DataFrame, again: Callable[[DataFrame], DataFrame], key: str, columns: list[str], default: dict[str, str]) -> DataFrame:
    """One row an item: ``columns`` of the first pass, of a second one over the items that the first left out, or ``default``."""
    once = first.select(key, *columns).dropDuplicates([key])
    left_out = items.join(once.select(key), key, "left_anti")
    answered = once.unionByName(again(left_out).select(key, *columns).dropDuplicates([key])).withColumn("__answered", F.lit(True))
    value = lambda c: F.when(F.col("__answered"), F.col(c)).otherwise(F.lit(default.get(c))).alias(c)
    return items.select(key).distinct().join(answered, key, "left").select(key, *map(value, columns))
