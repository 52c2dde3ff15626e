"""Dump the executed physical plan of every report and summarise its shape.

Usage: python tools/explain_all.py [sf_dir] [out_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.plans import catalog  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else "/tmp/ledgerlens-plans"
    os.makedirs(out, exist_ok=True)
    spark = local_session()
    for r in catalog.REPORTS:
        df = catalog.run(spark, sf_dir, r.name, normalised=False)
        df.collect()                    # run it, so explain shows the final adaptive plan
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        formatted = buf.getvalue()
        with open(os.path.join(out, f"{r.name}.txt"), "w") as fh:
            fh.write(formatted)
        final = formatted.split("== Initial Plan ==")[0]
        tree = final.split("\n\n")[0]          # the tree, before the node details
        lines = tree.splitlines()

        def count(word: str) -> int:
            return sum(1 for ln in lines if re.search(rf"\b{word}\b", ln))

        print(f"{r.name:42s} scans={count('Scan'):2d} "
              f"shuffles={count('Exchange'):2d} "
              f"broadcasts={count('BroadcastExchange'):2d} bhj={count('BroadcastHashJoin')} "
              f"smj={count('SortMergeJoin')} windows={count('Window')} sorts={count('Sort')}")
    spark.stop()


if __name__ == "__main__":
    main()
