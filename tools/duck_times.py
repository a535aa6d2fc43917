"""Median DuckDB seconds of the benchmark's SQL twins: duck_times.py SF_DIR [threads]; one warm-up, three runs."""

from __future__ import annotations

import json
import pathlib
import statistics
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from bench import HEADLINE  # noqa: E402
from splatlake import queries  # noqa: E402
from splatlake.fixtures import TABLES  # noqa: E402


def main() -> None:
    sf, threads = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 8
    queries.load()
    con = duckdb.connect(config={"threads": threads})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = {}
    for name in HEADLINE:
        if name in queries.ORACLES:
            runs = []
            for _ in range(4):
                start = time.perf_counter()
                con.execute(queries.ORACLES[name]).fetchall()
                runs.append(time.perf_counter() - start)
                if runs[0] > 20:
                    break
            out[name] = round(statistics.median(runs[1:] or runs), 3)
            print(name, out[name], file=sys.stderr, flush=True)
    print(json.dumps({"sf": pathlib.Path(sf).name, "threads": threads, "total": round(sum(out.values()), 3), "queries": out}))


if __name__ == "__main__":
    main()
