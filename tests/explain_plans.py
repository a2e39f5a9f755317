"""Write the physical plans of the headline queries to docs/PLANS.md.

    python tests/explain_plans.py [sf_dir]

Long expression bodies (array literals, lambdas) are shortened so the plan
shape stays readable.  Stage tables appear as Parquet scans; the plans that
build them are listed separately.
"""

from __future__ import annotations

import io
import re
import sys
from contextlib import redirect_stdout
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

QUERIES = ["canonical_per_start", "tours_dup_audit", "validity_report", "prefix_diversity",
           "symmetry_images", "board_edges", "score_by_start", "continuation_paths",
           "warnsdorff_paths", "seen_set_exclusion"]


def _short(line: str) -> str:
    line = re.sub(r"\[(-?\d+,){8,}-?\d+\]", "[…table…]", line)
    line = re.sub(r"array\((-?\d+, ){8,}-?\d+\)", "array(…table…)", line)
    return line if len(line) <= 220 else line[:217] + "…"


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("simple")
    return "\n".join(_short(x) for x in buf.getvalue().splitlines() if x.strip())


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from seqorbit.session import build_session
    spark = build_session()
    import __spark_entry__ as E
    from seqorbit.operators import corpus as C
    from seqorbit.operators import split as S
    from seqorbit.plans import catalog as K
    from pyspark.sql import functions as F

    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tests/explain_plans.py` on `{sf}` (local mode, AQE on; "
           "`isFinalPlan=false` is the plan before run-time re-optimisation).", ""]
    stage = {
        "stage: canonical dedup (A-6)": C.canonical_unique(K.tours(spark, sf)),
        "stage: exact split by group (P-2)": S.exact_fraction(
            K.canon(spark, sf).withColumn("k", F.col("tour_id").cast("string")), "k", 0.5,
            by=("start",), tie=("tour_id",)),
    }
    qs = E.queries()
    for name, df in list(stage.items()) + [(q, qs[q](spark, sf)) for q in QUERIES]:
        out += [f"## {name}", "", "```", _plan(df), "```", ""]
    (ROOT / "docs").mkdir(exist_ok=True)
    (ROOT / "docs" / "PLANS.md").write_text("\n".join(out))
    print("wrote docs/PLANS.md")


if __name__ == "__main__":
    main()
