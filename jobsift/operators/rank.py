"""Sort, limit, top-k.

A limit here is the feature itself (the reference's slice, sort and sample). A search may
hold any share of the rows and its limit may be any number, so positions within a search
come from ``positions``: a distributed sort and per-partition offsets, never a window over
a search's rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
SAMPLE_LINES = 5
# ---------------------------------------------------------------------------

BINS = 1024     # of a key's range at a time
SLACK = 8       # rows that may be sorted, in multiples of a key's limit
FEW = 10_000    # rows of a key that are sorted rather than looked through once more

log = logging.getLogger(__name__)

ARRIVAL = ("term_no", "loc_no", "source_no", "seq")


def arrival(df: DataFrame, order=ARRIVAL) -> list[str]:
    """The arrival-order columns that ``df`` has."""
    return [c for c in order if c in df.columns]


def positions(df: DataFrame, key: str, order: list[Column | str], name: str, cheap: bool = False) -> DataFrame:
    """Add the 1-based position of every row within its ``key`` (not null), by ``order``.

    The rows are written once, range-partitioned and sorted by key and order, so a big key
    spans many tasks. A sort reads its input twice, so that is written first unless ``cheap``
    says that it comes from a written table by little more than a filter. Per partition and key, the count and the first row give each
    partition's offset: a table of at most partitions + keys rows, over which the only
    window runs.
    """
    from jobsift.operators.dedup import cut_lineage

    rows = df if cheap else cut_lineage(df)
    spread_ = rows.orderBy(key, *order).withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    placed = cut_lineage(spread_)
    stats = placed.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_pid", key, "_off", "_first")
    at = F.col("_off") + F.col("_mid") - F.col("_first") + 1
    return placed.join(offsets, ["_pid", key]).withColumn(name, at).drop("_pid", "_mid", "_off", "_first")


def first_rows(df: DataFrame, key: str, order: list[str], limit: str, slack: int = SLACK, bins: int = BINS, few: int = FEW) -> DataFrame:
    """The rows of ``df`` that can be among the first ``limit`` of their ``key`` by ``order``.

    No row that belongs there is left out, and of a key with more rows than its limit at
    most ``slack`` times the limit (or ``few``) come back, so a small quota of a big key is
    not paid with a sort of the key. ``limit`` is a column, the same for all rows of a key; a
    null lifts it. ``order`` ends with an integer column; the columns before it have few
    values a key.

    The rows are written once. They are counted by key and leading columns, which settles
    all but one group of a key; in that group a histogram of the last column finds the bin
    where the limit falls, and is drawn anew within this bin until few enough rows are at
    or below it. Each pass reads the rows of the remaining bins and sends counts only.
    """
    from jobsift.operators.dedup import cut_lineage, release

    *head, last = order
    group = [key, *head]
    place = F.col(last).cast("decimal(20,0)")
    rows = cut_lineage(df)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.first(limit).alias("_limit"), F.min(place).alias("_low"), F.max(place).alias("_high"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(*head).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if head else F.lit(0).cast("long")
    sizes = sizes.withColumn("_before", before).where(F.col("_limit").isNull() | (F.col("_before") < F.col("_limit")))
    # _below rows of the group lie under _low; _n rows lie between _low and _high
    state = sizes.withColumn("_below", F.lit(0).cast("long"))
    crowded = F.col("_limit").isNotNull() & (F.col("_before") + F.col("_below") + F.col("_n") > F.greatest(slack * F.col("_limit"), F.lit(few))) & (F.col("_high") > F.col("_low"))
    state, seen = cut_lineage(state, {"open": F.count_if(crowded)})
    passes = 0
    while seen["open"]:
        wide = state.where(crowded)
        step = F.expr(f"(_high - _low) div {bins} + 1")
        inside = rows.join(wide.select(*group, "_low", "_high", step.alias("_step")), group).where(place.between(F.col("_low"), F.col("_high")))
        binned = inside.select(*group, "_low", "_step", F.expr(f"(cast(`{last}` as decimal(20,0)) - _low) div _step").alias("_bin")).groupBy(*group, "_low", "_step", "_bin").agg(F.count(F.lit(1)).alias("_n"))
        under = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        summed = (binned.withColumn("_under", F.coalesce(F.sum("_n").over(under), F.lit(0)))
                  .join(wide.select(*group, "_limit", "_before", "_below", "_high"), group)
                  .where(F.col("_before") + F.col("_below") + F.col("_under") < F.col("_limit")))
        chosen = summed.groupBy(*group).agg(F.max_by(F.struct("_low", "_step", "_bin", "_n", "_under", "_limit", "_before", "_below", "_high"), "_bin").alias("_c")).select(*group, "_c.*")
        low = F.col("_low") + F.col("_bin") * F.col("_step")
        narrowed = chosen.select(*group, "_n", "_limit", low.cast("decimal(20,0)").alias("_low"),
                                 F.least(F.col("_high"), low + F.col("_step") - 1).cast("decimal(20,0)").alias("_high"), "_before", (F.col("_below") + F.col("_under")).alias("_below"))
        following, seen = cut_lineage(state.where(~crowded).unionByName(narrowed), {"open": F.count_if(crowded)})
        release(state)
        state, passes = following, passes + 1
    log.info("the first rows of every key found in %d passes", passes)
    kept = rows.join(state.select(*group, F.col("_high").alias("_upto")), group).where(place <= F.col("_upto"))
    return kept.select(*df.columns)


def prefix_limit(df: DataFrame, n_col: str = "results_wanted", key: str = "search_id") -> DataFrame:
    """The first ``n_col`` rows of each search in arrival order (null: all of them).

    The form check rejects negative counts; one that gets here raises an error.
    """
    n = F.when(F.col(n_col) < 0, F.raise_error(F.lit("a result count is negative"))).otherwise(F.col(n_col))
    few = first_rows(df.withColumn("_limit_to", n.cast("long")), key, arrival(df), "_limit_to")
    ranked = positions(few, key, arrival(df), "_at", cheap=True)
    return ranked.where(F.col("_limit_to").isNull() | (F.col("_at") <= F.col("_limit_to"))).drop("_at", "_limit_to")


def rank_by_score(df: DataFrame, key: str = "search_id") -> DataFrame:
    """``rank`` 1.. by score descending; equal scores keep arrival order (stable sort)."""
    return positions(df, key, [F.col("score").desc_nulls_last(), *arrival(df)], "rank")


def sample_per_disposition(labelled: DataFrame, n: int = SAMPLE_LINES, keys=("search_id", "term_no", "disposition")) -> DataFrame:
    """The first ``n`` log lines of every reason per search term.

    ``n`` is a handful, so each map task forwards that many rows a reason before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*arrival(labelled, ("loc_no", "source_no", "seq")))
    return labelled.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
