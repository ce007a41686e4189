"""Run registered queries next to their SQL in DuckDB and compare whole results.

    python -m tests.oracle [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", round(v, 9) + 0.0)
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None))
    if isinstance(v, dt.date):
        return ("d", v)
    return ("s", str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def shares(rows, columns) -> bool:
    return all(r[c] is None or 0 <= r[c] <= 1 for r in rows for c in columns)


def zones(con) -> set:
    return {r[0] for r in con.execute("SELECT DISTINCT s_nationkey FROM supplier").fetchall()}


def ratios_hold(rows, con) -> bool:
    """Scores follow from the four counts of their row."""
    def same(x, top, below):
        return x is None if below == 0 else abs(x - top / below) < 1e-6
    return all(r["tp"] + r["fp"] + r["tn"] + r["fn"] > 0 and same(r["recall"], r["tp"], r["tp"] + r["fn"])
               and same(r["precision"], r["tp"], r["tp"] + r["fp"]) for r in rows)


def zones_score(rows, con) -> bool:
    """Scores of each zone count its own days with and without an event, as SQL has them."""
    from forewarn.plans.registry import with_tables
    days = {z: (a, b) for z, a, b in con.execute(with_tables(
        "SELECT zone, count(*) FILTER (event = 1), count(*) FILTER (event = 0) FROM (SELECT zone, date, max(event) AS event FROM station_flagged GROUP BY 1, 2) GROUP BY 1")).fetchall()}
    both = {z for z, (a, b) in days.items() if a and b}
    return ratios_hold(rows, con) and {r["zone"] for r in rows} == both and all((r["tp"] + r["fn"], r["fp"] + r["tn"]) == days[r["zone"]] for r in rows)


def stations_weighed(rows, con) -> bool:
    """Every station of each zone with both classes has a share, and the shares of a zone add up to one unless no tree was split."""
    from forewarn.plans.registry import with_tables
    known = set(con.execute(with_tables("SELECT DISTINCT zone, station FROM station_flagged")).fetchall())
    total: dict = {}
    for r in rows:
        total[r["zone"]] = total.get(r["zone"], 0) + r["importance"]
    return {(r["zone"], r["station"]) for r in rows} == {k for k in known if k[0] in total} and all(
        abs(v - 1) < 1e-6 or v == 0 for v in total.values()) and any(total.values())


def search_holds(rows, con) -> bool:
    """The chosen set is one of those drawn, and the scores count the events and months of each split."""
    from forewarn.plans import load
    design = con.execute(f"SELECT lead, part, sum(months), sum(events), list((set, depth, child_weight, eta, gamma)) FROM ({load()['x34b_search_design'].sql}) WHERE fold IS NOT NULL GROUP BY 1, 2").fetchall()
    for lead, part, months, events, sets in design:
        own = [r for r in rows if (r["lead"], r["part"]) == (lead, part)]
        drawn = {tuple(float(x) for x in (s.values() if isinstance(s, dict) else s)) for s in sets}
        n = len({s[0] for s in drawn})
        if sum(r["tp"] + r["fn"] for r in own) * n != events or sum(r["tp"] + r["fn"] + r["fp"] + r["tn"] for r in own) * n != months:
            return False
        if any(not any(all(abs(a - b) < 1e-9 for a, b in zip(s, (r["set"], r["depth"], r["child_weight"], r["eta"], r["gamma"]))) for s in drawn) for r in own):
            return False
    return ratios_hold([r for r in rows if r["tp"] + r["fp"] + r["tn"] + r["fn"]], con) and all(0 <= r["cv_recall"] <= 1 for r in rows)


#: What must hold of the rows of queries that SQL cannot express.
CHECKS = {
    "x20b_return_levels_mle": lambda rows, con: all(
        r["low"] is None or r["converged"] and r["low"] <= r["estimate"] <= r["high"] for r in rows) and any(r["converged"] for r in rows),
    "x31_sparse_logistic": ratios_hold, "x33_boosted_trees": zones_score, "x33b_station_importances": stations_weighed, "x34_tuned_trees": search_holds, "x35_loss_tree": ratios_hold,
    "x37_classifier_comparison": ratios_hold,
    "x31b_coefficients": lambda rows, con: len(rows) == len({r["feature"] for r in rows}) == 5,
    "x31c_strength_path": lambda rows, con: len(rows) == 6 and shares(rows, ["f1_positive"]),
    "x36_importances": lambda rows, con: abs(sum(r["importance"] for r in rows) - 1) < 1e-6 and min(r["importance"] for r in rows) >= 0,
}


def compare(spark, con, q, sf: str) -> tuple[bool, str]:
    df = q.run(spark, sf)
    names, got = rows_of(df.columns, df.collect())
    if q.sql is None:
        if q.name not in CHECKS:
            return False, "neither SQL nor a check of its rows"
        records = [dict(zip(names, (c[1] if c else None for c in r))) for r in got]
        return bool(records) and CHECKS[q.name](records, con), f"checked {len(got)} rows"
    cur = con.execute(q.sql)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    bad = [f"{n}:{k}" for n, k in kinds.items() if k in ("HUGEINT", "BOOLEAN", "FLOAT") or "DECIMAL" in k]
    if bad:
        return False, f"oracle types {bad}"
    if names != want_names:
        return False, f"columns {names} vs {want_names}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    if diff:
        return False, f"{len(diff)} of {len(got)} rows differ, e.g. {names}\n   {diff[0][0]}\n   {diff[0][1]}"
    return True, f"{len(got)} rows"


def main() -> int:
    from forewarn.plans import load
    from forewarn.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name, q in load().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, q, sf)
        except Exception as e:  # noqa: BLE001 - a report over all queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
