"""Scale check: row counts, approved rows and de-duplication rounds per scale factor.

Usage: python tools/scale_check.py [sf_dir ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from jobsift.operators import dedup as E
    from jobsift.plans import catalog as C
    from jobsift.plans import pipelines as L
    from jobsift.session import get_spark
    from jobsift.sources import fixtures as V

    dirs = sys.argv[1:] or [f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1")]
    spark = get_spark("local[8]")
    for d in dirs:
        t0 = time.time()
        narrow = E.cut_lineage(C._single(spark, d).select(*L.NARROW))
        approved, rounds = E.greedy_two_key(narrow.where("candidate"))
        labelled = E.cut_lineage(L.intake(V.raw_postings(spark, d), C._scope_grid(spark), C.AS_OF).labelled)
        _, scope_rounds = E.greedy_two_key(labelled.where("candidate"))
        print(f"{d}: rows={narrow.count()} candidates={narrow.where('candidate').count()} approved={approved.count()} rounds={rounds} | "
              f"3-location scope rows={labelled.count()} approved={labelled.where(labelled.disposition == E.APPROVED).count()} "
              f"rounds={scope_rounds} | {time.time() - t0:.1f}s", flush=True)


if __name__ == "__main__":
    main()
