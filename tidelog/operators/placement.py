"""Choosing the units of an ensemble."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotEnoughUnits
from ..functions import zone_or_default

#: What cpu, memory and disk weigh in a unit's pressure.
CPU, MEMORY, DISK = 0.4, 0.4, 0.2


def pressure() -> Column:
    return F.col("cpu") * CPU + F.col("mem") * MEMORY + F.col("disk") * DISK


def writable(units: DataFrame) -> DataFrame:
    return units.where(F.col("status") == "WRITABLE")


def zone_counts(units: DataFrame) -> DataFrame:
    return units.groupBy(zone_or_default(F.col("zone")).alias("zone")).agg(F.count("*").alias("n"))


def select_ensemble(units: DataFrame, include: DataFrame, exclude: DataFrame, rf: int) -> DataFrame:
    """rf units (address, zone, place), or none if so many are not to be had.

    units: (pos, address, zone, status, cpu, mem, disk); include: (address, rank), kept
    first in their order if writable; exclude: (address). The rest is drawn zone by zone,
    the least pressed unit of each first, zones with fewer kept units before others.
    """
    candidates = (
        writable(units).join(exclude, "address", "left_anti")
        .select("pos", "address", zone_or_default(F.col("zone")).alias("zone"), pressure().alias("pressure"))
    )
    kept = candidates.join(include, "address").withColumn("_order", F.row_number().over(W.orderBy("rank"))).where(F.col("_order") <= rf)
    used = kept.groupBy("zone").agg(F.count("*").alias("used"))
    rest = candidates.join(include, "address", "left_anti").join(used, "zone", "left")
    ranked = rest.withColumn("_rn", F.row_number().over(W.partitionBy("zone").orderBy("pressure", "pos")))
    # one row for each unit of a cluster: a few thousand
    drawn = ranked.withColumn("_order", F.row_number().over(W.orderBy("_rn", F.coalesce("used", F.lit(0)), "zone")) + F.lit(1_000_000))
    every = kept.select("address", "zone", "_order").unionByName(drawn.select("address", "zone", "_order"))
    placed = every.withColumn("place", F.row_number().over(W.orderBy("_order"))).withColumn("_n", F.count("*").over(W.partitionBy(F.lit(1))))
    return placed.where((F.col("place") <= rf) & (F.col("_n") >= rf)).select("address", "zone", F.col("place").cast("bigint").alias("place"))


def find_replacement(listing, healthy: list[str], quarantined: list[str], rf: int, tries: int = 5, wait: float = 0.1) -> tuple[list[str], list[str]]:
    """(ensemble, who is still quarantined): looks for rf units with the healthy ones kept; without enough, the unit longest in
    quarantine is forgiven; with none left there, the listing (a callable giving the units) is asked again, tries times in all."""
    left = list(quarantined)
    for n in range(tries):
        units = listing()
        as_rows = units.sparkSession.createDataFrame
        while True:
            include = as_rows([(a, i) for i, a in enumerate(healthy)], "address string, rank int")
            chosen = select_ensemble(units, include, as_rows([(a,) for a in left], "address string"), rf)
            found = [r["address"] for r in chosen.orderBy("place").collect()]  # as many as replicas
            if found:
                return found, left
            if not left:
                break
            left.pop(0)
        time.sleep(wait * 2**n)
    raise NotEnoughUnits(f"{rf} units wanted")
