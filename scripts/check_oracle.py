"""Compare every registered query with its DuckDB oracle (row count, columns, value hash).

Usage: python scripts/check_oracle.py [sf_dir] [key ...]
Also rewrites riskframe/plans/oracle_manifest.json from the Spark output schemas.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from riskframe.plans import all_queries  # noqa: E402
from riskframe.plans.registry import MANIFEST, REGISTRY, load_manifest, oracle_sql_map, query_map  # noqa: E402
from riskframe.session import get_session  # noqa: E402
from riskframe.sources.fixtures import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    all_queries.load()
    spark = get_session()
    manifest = load_manifest()
    qs = query_map()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    results = {}
    for key in REGISTRY:
        if only and key not in only:
            continue
        t0 = time.time()
        try:
            df = qs[key](spark, sf_dir)
            manifest[key] = [[f.name, f.dataType.simpleString()] for f in df.schema.fields]
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[key] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            traceback.print_exc()
            continue
        t_spark = time.time() - t0
        with open(MANIFEST, "w") as fh:
            json.dump(manifest, fh, indent=0, sort_keys=True)
        sql = oracle_sql_map().get(key)
        if sql is None:
            results[key] = f"rows-only rows={len(srows)} ({t_spark:.1f}s)"
            continue
        try:
            rel = con.execute(sql)
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[key] = f"DUCKDB ERROR {str(e)[:400]}"
            continue
        ok_rows = len(srows) == len(drows)
        ok_cols = sorted(scols) == sorted(dcols)
        ok_hash = ok_cols and digest(scols, srows) == digest(dcols, drows)
        status = "OK" if (ok_rows and ok_cols and ok_hash) else "MISMATCH"
        results[key] = f"{status} rows={len(srows)}/{len(drows)} cols={ok_cols} hash={ok_hash} ({t_spark:.1f}s)"
        if status != "OK":
            if not ok_cols:
                results[key] += f" spark={sorted(scols)} duck={sorted(dcols)}"
            else:
                order_s = sorted(range(len(scols)), key=lambda i: scols[i])
                order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
                a = sorted(json.dumps([_norm(r[i]) for i in order_s], default=str) for r in srows)
                b = sorted(json.dumps([_norm(r[i]) for i in order_d], default=str) for r in drows)
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                results[key] += f"\n   cols={sorted(scols)}\n   diff={diff}"
    with open(MANIFEST, "w") as fh:
        json.dump(manifest, fh, indent=0, sort_keys=True)
    for k, v in results.items():
        print(f"{k}: {v}")
    bad = [k for k, v in results.items() if not (v.startswith("OK") or v.startswith("rows-only"))]
    print(f"SUMMARY {len(results) - len(bad)}/{len(results)} ok; bad={bad}")


if __name__ == "__main__":
    main()
