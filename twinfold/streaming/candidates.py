"""Candidates for arriving offers: a stream of signatures against the written band index (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.blocking import bands


def match_stream(new_sigs: DataFrame, index: DataFrame, b: int, r: int) -> DataFrame:
    """brand, oid1 (indexed), oid2 (new): stateless stream-static join; an offer pair may come once for each shared band.

    index holds bands() of the known offers, best bucketed by (brand, band, key).
    """
    new = bands(new_sigs, b, r).withColumnRenamed("offer_id", "oid2")
    return new.join(index.withColumnRenamed("offer_id", "oid1"), ["brand", "band", "key"]).filter("oid1 <> oid2").select("brand", "oid1", "oid2")
