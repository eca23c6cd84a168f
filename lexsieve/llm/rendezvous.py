"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 52


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from the first 52 bits of md5(key|shard): the least score owns the key."""
    digits = F.substring(F.md5(F.concat_ws("|", key, F.lit(str(shard))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(_SPAN))
    return -F.ln(u) / F.lit(float(weight))


def assign_shards(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id") -> DataFrame:
    """(doc_id, shard): the shard of each record, one row for each row of docs.

    Every shard scores every key by itself, so that adding a shard moves records only to it, removing one moves only its
    own, and a shard's share follows its weight (positive).
    A null key gives a null shard; rows that share a key go to one shard; equal scores go to the lowest shard number;
    text and other columns are not read; an empty table gives an empty result.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive and there must be a shard")
    key = docs[id_col].cast("string")
    owner = F.array_min(F.array(*[F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]))
    return docs.select(docs[id_col].alias("doc_id"), F.when(docs[id_col].isNotNull(), owner["shard"]).alias("shard"))


def assign_shards_sql(table: str, weights: dict[int, float], id_col: str = "doc_id") -> str:
    """The same in DuckDB SQL."""
    shards = ", ".join(f"({s}, {float(w)!r}::DOUBLE)" for s, w in sorted(weights.items()))
    return f"""
        WITH shards(shard, weight) AS (VALUES {shards}),
        docs AS (SELECT {id_col} AS doc_id, row_number() OVER () AS nth FROM {table}),
        scored AS (
            SELECT nth, doc_id, shard,
                   -ln(((('0x' || substr(md5(doc_id::VARCHAR || '|' || shard::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(_SPAN)!r}) / weight AS score
            FROM docs, shards)
        SELECT doc_id, CASE WHEN doc_id IS NOT NULL THEN shard END::INTEGER AS shard
        FROM scored
        QUALIFY row_number() OVER (PARTITION BY nth ORDER BY score, shard) = 1"""
