"""De-duplication.

The reference walks rows in arrival order with two seen-sets (link, fingerprint) and
adds a row's keys only when it is approved. That is the lexicographically-first
maximal matching of the link/fingerprint graph, computed here exactly in rounds:
a remaining candidate is approved when it is first in both its link group and its
fingerprint group; rows sharing a key with an approved row are removed; repeat.

A round is two grouped minima (combined before the shuffle, so a key with a third of all
rows is no hot group), an equi-join of the two small tables of minima on the unique
position, and two anti-joins whose big side is read from a written table, so adaptive
execution can split a hot key there. Every round approves at least one row, so it ends.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jobsift.session import delete_folder, ensure_checkpoint_dir

log = logging.getLogger(__name__)

SCOPE = ("search_id", "term_no")
ORDER = ("loc_no", "source_no", "seq")

APPROVED = "approved"
DUP_LINK = "duplicated_link"
DUP_FINGERPRINT = "duplicated_fingerprint"
MISSING_KEYWORD = "rejected_missing_keyword"
IRRELEVANT = "rejected_strict_relevance"
INVALID = "rejected_invalid"


def _order(df: DataFrame) -> list[str]:
    """The position columns within a scope that ``df`` has."""
    return [c for c in ORDER if c in df.columns]


def cut_lineage(df: DataFrame, metrics: dict[str, F.Column] | None = None):
    """Materialise ``df`` as Parquet in the cluster's checkpoint folder and read it back.

    The folder is the shared one named by ``spark.checkpoint.dir`` (survives executor
    loss; never a machine-local or local checkpoint). One job computes the frame once,
    where an eager RDD checkpoint would compute it twice. With ``metrics`` (aggregate
    columns) the same job also observes them and ``(frame, values)`` is returned, so
    no second job is needed to count or check the result.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jobsift-{uuid.uuid4().hex}"
    obs = None
    if metrics:
        obs = Observation(f"cut-{uuid.uuid4().hex}")
        df = df.observe(obs, *[c.alias(k) for k, c in metrics.items()])
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._jobsift_folder = path
    return (out, obs.get) if obs is not None else out


def release(*frames: DataFrame) -> None:
    """Delete the folders of frames from ``cut_lineage`` that nothing reads any more."""
    for frame in frames:
        delete_folder(frame.sparkSession, frame._jobsift_folder)


def first_per_key(df: DataFrame, key: str, scope=SCOPE) -> DataFrame:
    """Per key value within the scope, the position of its first row by arrival."""
    return df.groupBy(*scope, key).agg(F.min(F.struct(*_order(df))).alias("_first")).select(*scope, key, "_first.*")


def _unmatched(rows: DataFrame, approved: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share ``keys`` with no approved row."""
    return rows.join(approved.select(*keys), keys, "left_anti")


def greedy_two_key(cands: DataFrame, scope=SCOPE, link: str = "link", fp: str = "fingerprint") -> tuple[DataFrame, int]:
    """Approved (scope, position, link, fingerprint) rows of the sequential loop.

    ``cands`` must hold only rows that would pass every non-duplicate check, with both keys.
    Returns the approved rows and the number of rounds used.
    """
    order, keys = _order(cands), [*scope, *_order(cands)]
    # Rows equal in both keys: only the first of them can ever be approved.
    rest = cut_lineage(cands.groupBy(*scope, link, fp).agg(F.min(F.struct(*order)).alias("_p")).select(*scope, "_p.*", link, fp))
    won_parts: list[DataFrame] = []
    left = 1
    while left:
        by_link = rest.groupBy(*scope, link).agg(F.min(F.struct(*order, fp)).alias("_m")).select(*scope, "_m.*", link)
        by_fp = rest.groupBy(*scope, fp).agg(F.min(F.struct(*order)).alias("_m")).select(*scope, "_m.*")
        won = cut_lineage(by_link.join(by_fp, keys))
        won_parts.append(won)
        remaining, seen = cut_lineage(
            _unmatched(_unmatched(rest, won, [*scope, link]), won, [*scope, fp]),
            {"left": F.count(F.lit(1))})
        left = seen["left"]
        release(rest)
        rest = remaining
    release(rest)
    log.info("two-key de-duplication settled in %d rounds", len(won_parts))
    out = won_parts[0]
    for part in won_parts[1:]:
        out = out.unionByName(part)
    approved = cut_lineage(out)
    release(*won_parts)
    return approved, len(won_parts)


def label(annotated: DataFrame, approved: DataFrame, scope=SCOPE, link: str = "link", fp: str = "fingerprint") -> DataFrame:
    """E5: disposition of every row, in the loop's order of checks.

    A row is a link duplicate when an *earlier* approved row shares its link, else a
    fingerprint duplicate when an earlier approved row shares its fingerprint.
    Approved rows have distinct links and fingerprints per scope, so the joins are
    one-to-one lookups.
    """
    order = _order(annotated)
    pos = F.struct(*order)
    a_link = approved.select(*scope, link, F.struct(*order).alias("_al"))
    a_fp = approved.select(*scope, fp, F.struct(*order).alias("_af"))
    # Rows without a link are invalid whatever else they hold; they skip the joins, where
    # they would all meet under the null key.
    valid = annotated.where("valid")
    invalid = annotated.where("not valid").withColumn("disposition", F.lit(INVALID))
    j = valid.join(a_link, [*scope, link], "left").join(a_fp, [*scope, fp], "left")
    disposition = (
        F.when(F.col("_al").isNotNull() & (F.col("_al") < pos), F.lit(DUP_LINK))
        .when(F.col("_af").isNotNull() & (F.col("_af") < pos), F.lit(DUP_FINGERPRINT))
        .when(F.col("missing_word").isNotNull(), F.lit(MISSING_KEYWORD))
        .when(~F.col("relevant"), F.lit(IRRELEVANT))
        .otherwise(F.lit(APPROVED))
    )
    return j.withColumn("disposition", disposition).drop("_al", "_af").unionByName(invalid)


def dedup_two_key(annotated: DataFrame, scope=SCOPE) -> DataFrame:
    """E3+E5 on an annotated frame: every row with its disposition."""
    approved, _ = greedy_two_key(annotated.where("candidate"), scope=scope)
    return label(annotated, approved, scope=scope)
