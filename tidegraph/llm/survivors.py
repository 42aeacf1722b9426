"""One golden record for each cluster of records, by declarative aggregates.

A first aggregate finds each cluster's latest time and size, which a join brings back to its records;
then each field is a ``max_by`` over a struct of what its rule looks at, and one more aggregate picks the balance with the
chosen segment joined to it.  All aggregates are combined before their shuffle, so a cluster
with a third of the records is a few rows there.  In the join the clusters of over 1/1024 of the records (at most 1023)
are broadcast, so their records stay where they are; the others go through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stored

#: Sources by falling trust; others come after them.
TRUST = ("crm", "web", "store", "partner")
SPACE = " \t\n\x0b\x0c\r"
SHARE = 1024


def known(column: str) -> Column:
    """A string, or null where it is empty or blank."""
    return F.when(F.length(F.btrim(F.col(column), F.lit(SPACE))) > 0, F.col(column))


def trust(source: Column, order: Sequence[str]) -> Column:
    out = F.lit(0)
    for i, name in enumerate(order):
        out = F.when(source == name, len(order) - i).otherwise(out)
    return out


def with_cluster(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """``rows`` with the columns of their cluster, of which ``clusters`` (a stored table: cluster_id, n_records, ...) has one row each.

    Heavy clusters go to their rows, of the others both sides are shuffled.
    """
    total = clusters.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    heavy = F.col("n_records") * SHARE > total
    few = F.broadcast(clusters.where(heavy).withColumnRenamed("cluster_id", "_id"))
    same = F.col("cluster_id").eqNullSafe(F.col("_id"))
    here = rows.join(few, same).drop("_id")
    rest = rows.join(few.select("_id"), same, "left_anti")
    return here.unionByName(rest.join(clusters.where(~heavy).withColumnRenamed("cluster_id", "_id").hint("shuffle_merge"), same).drop("_id"))


def golden_records(records: DataFrame, order: Sequence[str] = TRUST, stale_hours: int = 60 * 24) -> DataFrame:
    """One row a cluster: cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance, and the client_id that each comes from.

    A cluster is the records of one master_id, or client_id where that is null; records without either are one
    cluster of the null id.  Blank strings count as null.  A record is stale if it has no updated_at, or one more than ``stale_hours`` before
    its cluster's latest.  RECENT: latest updated_at (null last), higher trust (unknown and missing sources last), smaller client_id (null last).
    TRUSTED: fresh before stale, higher trust, then RECENT.  Records equal in all of these are told apart by the larger value, so reruns
    agree.  Segment by RECENT, email by TRUSTED, name by code points and TRUSTED, the first that is not null; city and nation_id from one record, by the number of them that it has and
    RECENT; balance (NaN and infinite ones count as null) from records with the chosen segment before all others, then by RECENT.
    The names ``*_from`` are null where the field is.  Other columns are ignored; an empty table gives no rows.
    """
    balance = F.col("balance").cast("double")
    rows = records.select(
        F.coalesce("master_id", "client_id").alias("cluster_id"), "client_id", "updated_at", trust(known("source"), order).alias("trust"),
        *[known(c).alias(c) for c in ("name", "email", "city", "segment")], "nation_id", F.when(~F.isnan(balance) & (F.abs(balance) < float("inf")), balance).alias("balance"))
    latest = stored(rows.groupBy("cluster_id").agg(F.max("updated_at").alias("latest"), F.count("*").alias("n_records")), "clusters")
    joined = with_cluster(rows, latest)
    fresh = F.coalesce(F.col("updated_at") >= F.col("latest") - F.make_dt_interval(hours=F.lit(stale_hours)), F.lit(False))
    # of whole numbers, ~x falls as x rises; a null is below all values in a struct
    recent = (F.col("updated_at"), F.col("trust"), F.bitwise_not(F.col("client_id")))
    trusted = (fresh, F.col("trust"), *recent)

    def first(value: Column, *key: Column) -> Column:
        """(value, client_id) of the first record in the key's order that has a value."""
        return F.max_by(F.struct(value.alias("value"), F.col("client_id").alias("source")), F.when(value.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate((*key, value))])))

    address = F.struct("city", "nation_id")
    filled = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    best = joined.groupBy("cluster_id").agg(
        F.count("*").alias("n_records"), F.count_if(~fresh).alias("n_stale"),
        first(F.col("name"), F.length("name"), *trusted).alias("name"), first(F.col("email"), *trusted).alias("email"), first(F.col("segment"), *recent).alias("segment"), first(address, filled, *recent).alias("address"))
    best = stored(best, "clusters")
    # a cluster's records are as many rows as it has segments by now
    balances = rows.where("balance is not null").groupBy("cluster_id", "segment").agg(first(F.col("balance"), *recent).alias("b"), F.max(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(recent)])).alias("at"))
    chosen = with_cluster(balances, best.select("cluster_id", "n_records", F.col("segment.value").alias("chosen")))
    picked = chosen.groupBy("cluster_id").agg(F.max_by("b", F.struct(F.col("segment").eqNullSafe(F.col("chosen")), F.col("at"), F.col("b.value"))).alias("b")).withColumnRenamed("cluster_id", "_id")
    out = best.hint("shuffle_merge").join(picked, F.col("cluster_id").eqNullSafe(F.col("_id")), "left")
    place = F.col("address.value")
    return out.select(
        "cluster_id", "n_records", "n_stale", F.col("name.value").alias("name"), F.col("email.value").alias("email"), F.col("segment.value").alias("segment"), place["city"].alias("city"), place["nation_id"].alias("nation_id"), F.col("b.value").alias("balance"),
        F.col("name.source").alias("name_from"), F.col("email.source").alias("email_from"), F.col("segment.source").alias("segment_from"), F.col("b.source").alias("balance_from"),
        F.when(place["city"].isNotNull() | place["nation_id"].isNotNull(), F.col("address.source")).alias("address_from"))
