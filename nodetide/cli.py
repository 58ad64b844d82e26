"""Commands: validate, extract, dfc, diagnose, merge-manifests, fixture."""

from __future__ import annotations

import argparse
from collections import Counter


def _shard(text: str) -> tuple[int, int]:
    try:
        i, n = (int(x) for x in text.split("/"))
    except ValueError:
        raise argparse.ArgumentTypeError(f"a shard looks like I/N, not {text!r}") from None
    if not 0 <= i < n:
        raise argparse.ArgumentTypeError(f"shard {i} isn't below {n}")
    return i, n


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nodetide", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--n-jobs", type=int, help="local cores; a cluster's own settings count otherwise")
    common.add_argument("--shard", type=_shard)
    common.add_argument("--overwrite", action="store_true")
    for name in ("validate", "extract", "dfc", "diagnose", "merge-manifests"):
        c = sub.add_parser(name, parents=[common] if name in ("extract", "dfc") else [])
        c.add_argument("config")
        if name == "extract":
            c.add_argument("--limit", type=int)
            c.add_argument("--no-strict", action="store_true")
            c.add_argument("--scans", help="table of the scans that runs are made of: sub, task, run, acq_s, n_vols")
        elif name == "dfc":
            c.add_argument("--window-s", type=float, nargs="+")
        elif name == "diagnose":
            c.add_argument("--isc-parcels", nargs="+")
        elif name == "merge-manifests":
            c.add_argument("--stage", choices=("activation", "dfc"), required=True)
    c = sub.add_parser("fixture")
    c.add_argument("root")
    c.add_argument("--n-subs", type=int, default=4)
    c.add_argument("--n-tr", type=int, default=240)
    return p


def _report(entries) -> int:
    counts = Counter(e.status for e in entries)
    print("  ".join(f"{k}={n}" for k, n in sorted(counts.items())))
    for e in entries:
        if e.status in ("error", "empty"):
            print(f"{e.status} {e.sub}/{e.task}/{e.atlas}: {e.detail}")
    return int(counts["error"] > 0)


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "fixture":
        from nodetide.sources.fixture import make_fixture

        made = make_fixture(args.root, args.n_subs, args.n_tr)
        print(f"fixture in {made['root']}, configuration {made['config']}")
        return 0
    from pyspark.sql import SparkSession

    from nodetide.config import load_config
    from nodetide.plans import stages
    from nodetide.sources import storage

    builder = SparkSession.builder.appName(f"nodetide {args.command}").config("spark.sql.session.timeZone", "UTC").config("spark.executorEnv.OMP_NUM_THREADS", "1")
    if getattr(args, "n_jobs", None):
        builder = builder.master(f"local[{args.n_jobs}]")
    spark, cfg = builder.getOrCreate(), load_config(args.config)
    if args.command == "validate":
        _, problems = stages.planned_runs(spark, cfg, strict=False)
        print("\n".join(problems) or "no problems")
        return int(bool(problems))
    if args.command == "extract":
        return _report(stages.extract_stage(spark, cfg, not args.no_strict, args.shard, args.overwrite, args.limit, args.scans))
    if args.command == "dfc":
        return _report(stages.dfc_stage(spark, cfg, args.window_s, args.shard, args.overwrite))
    if args.command == "diagnose":
        status = stages.diagnose_stage(spark, cfg, args.isc_parcels)
        print(f"alignment gate: {status}")
        return 2 if status == "failed" else 0
    return _report(storage.merge_manifests(spark, cfg.output_root, cfg.cohort, args.stage, cfg.to_dict()))


if __name__ == "__main__":
    raise SystemExit(main())
