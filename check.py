"""Run registered queries next to their SQL and print what differs: check.py FOLDER [NAME_PREFIX ...]."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import compare  # noqa: E402
from gridlens.plans import catalog  # noqa: E402
from gridlens.session import build_session  # noqa: E402


def main(folder: str, prefixes: list[str]) -> int:
    spark = build_session("local[8]", shuffle_partitions=8, driver_memory="12g")
    connection = compare.connect(folder)
    failed = 0
    for name, function in catalog.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in catalog.ORACLES:
                problem = compare.differences(function(spark, folder), connection, catalog.ORACLES[name])
            else:
                problem = None if function(spark, folder).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "sql" if name in catalog.ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
