"""Commands of the engine."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date, datetime
from pathlib import Path

from marlstone.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", description="Panel time-series engine on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("contracts", help="list feature contracts")
    q = sub.add_parser("query", help="run a registered query")
    q.add_argument("name")
    q.add_argument("tables", help="folder of the tables")
    q.add_argument("--out", help="write Parquet here instead of showing rows")
    i = sub.add_parser("ingest-synthetic", help="make and ingest a synthetic panel")
    i.add_argument("root")
    i.add_argument("tickers", nargs="+")
    i.add_argument("--days", type=int, default=500)
    f = sub.add_parser("build-features", help="feature matrix of a panel in Parquet")
    f.add_argument("panel")
    f.add_argument("out")
    m = sub.add_parser("materialize", help="publish columns of a Parquet frame to a store")
    m.add_argument("frame")
    m.add_argument("store")
    m.add_argument("name")
    m.add_argument("columns", nargs="+")
    v = sub.add_parser("validate", help="verify a stored object or a bundle")
    v.add_argument("kind", choices=["object", "bundle"])
    v.add_argument("root")
    v.add_argument("id")
    a = sub.add_parser("as-of", help="prices of a bundle as known at an instant")
    a.add_argument("root")
    a.add_argument("id")
    a.add_argument("instant", help="ISO 8601 with a time zone")
    r = sub.add_parser("report", help="portfolio report over the driver's tables")
    r.add_argument("tables")
    t = sub.add_parser("train-model", help="walk-forward scores of a panel in Parquet")
    t.add_argument("panel")
    t.add_argument("out")
    t.add_argument("--settings", help="JSON file")
    k = sub.add_parser("run-backtest", help="figures of scores in Parquet (date, ticker, score)")
    k.add_argument("panel")
    k.add_argument("scores")
    k.add_argument("--settings", help="JSON file")
    w = sub.add_parser("run-full-pipeline", help="features, scores, backtest and report of a panel in Parquet")
    w.add_argument("panel")
    w.add_argument("--settings", help="JSON file")
    w.add_argument("--runs", help="folder of the tracked record")
    b = sub.add_parser("backfill-features", help="feature matrix of a panel by years, resumable")
    b.add_argument("panel")
    b.add_argument("root")
    b.add_argument("start")
    b.add_argument("end")
    x = sub.add_parser("export-bundle", help="publish price records in Parquet as a bundle")
    x.add_argument("records")
    x.add_argument("root")
    x.add_argument("name")
    e = sub.add_parser("list-experiments")
    e.add_argument("root")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print("marlstone 0.1.0")
        return 0
    from marlstone import flow
    from marlstone import report as rp
    from marlstone.operators import contracts, features
    from marlstone.plans import panels, registry
    from marlstone.sources import backfill, bundle, store, tracker, vendors

    spark = session()
    if args.command == "contracts":
        contracts.metadata(spark).show(100, False)
    elif args.command == "query":
        df = registry.queries()[args.name](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, False)
    elif args.command == "ingest-synthetic":
        vendors.ingest(spark, args.root, lambda: vendors.synthetic_panel(spark, args.tickers, args.days), "1900-01-01", "2999-12-31", {"tickers": args.tickers, "days": args.days}).show(5)
    elif args.command == "build-features":
        panel = panels.with_market(panels.with_returns(spark.read.parquet(args.panel)))
        features.build_features(panel).write.mode("overwrite").parquet(args.out)
    elif args.command == "materialize":
        frame = spark.read.parquet(args.frame)
        names = tuple(r["ticker"] for r in frame.select("ticker").distinct().collect())
        print(json.dumps(store.FeatureStore(spark, args.store).materialize(frame, store.Request(args.name, tuple(args.columns), names)), indent=1))
    elif args.command == "validate":
        ok = store.FeatureStore(spark, args.root).validate(args.id) if args.kind == "object" else bool(bundle.validate(spark, args.root, args.id))
        print("valid" if ok else "changed")
        return 0 if ok else 1
    elif args.command == "as-of":
        bundle.load(spark, args.root, args.id, datetime.fromisoformat(args.instant)).prices.show(20, False)
    elif args.command == "report":
        q = registry.queries()
        print(rp.report("Portfolio", [(n, q[k](spark, args.tables)) for n, k in (("Performance", "r05_performance_summary"), ("Costs", "g01_cost_sensitivity"), ("Capacity", "g04_liquidity_capacity"), ("Stress", "r07_stress"), ("Months", "a04_monthly_returns"))]))
    elif args.command in ("train-model", "run-backtest", "run-full-pipeline"):
        tree = json.loads(Path(args.settings).read_text()) if args.settings else {}
        s, panel = flow.settings(tree), panels.with_market(panels.with_returns(spark.read.parquet(args.panel)))
        if args.command == "train-model":
            flow.scores(panel, s)[0].write.mode("overwrite").parquet(args.out)
        elif args.command == "run-backtest":
            print(flow.backtest(panel, spark.read.parquet(args.scores), s).report(s.name))
        else:
            print(flow.run(spark, panel, s, args.runs).report(s.name))
    elif args.command == "backfill-features":
        panel = panels.with_market(panels.with_returns(spark.read.parquet(args.panel)))
        plan = backfill.parts(date.fromisoformat(args.start), date.fromisoformat(args.end))
        job = backfill.Backfill(spark, args.root, "features", plan)
        print(job.run(lambda part: features.build_features(backfill.window(panel, part, 600, 1))).count())
    elif args.command == "export-bundle":
        print(bundle.export(spark, args.root, {"prices": spark.read.parquet(args.records)}, {"name": args.name}))
    elif args.command == "list-experiments":
        tracker.JsonTracker(spark, args.root).runs().show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
