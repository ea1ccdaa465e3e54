"""python -m tilewright.cli: list what there is, build, load and check indexes.

    list                               detectors, ops and pools
    index SPEC OUT [--boxes FILE] ..   load an index of frames, or build it by a detector
    stats INDEX                        counts, rates, quartiles and labels
    dump INDEX FILE [--form F]         an index as a box file
    check INDEX WIDTH HEIGHT           contract violations; exits with 1 if there are any
    generate INDEX SPEC                check the pairs of an index over its frames
    augment [--set OP=OPTIONS ..]      check an augmenter on a synthetic frame

An index is a folder of tables or, by the ending .json, a box file. --pools FILE before the
command names pools (JSON).
"""

from __future__ import annotations

import argparse
import ast
import json
import sys


def setting(text: str) -> tuple[str, object]:
    """K=V, with V a Python literal or else a string."""
    key, eq, value = text.partition("=")
    if not eq:
        raise argparse.ArgumentTypeError(f"{text!r} is no K=V")
    try:
        return key.strip(), ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return key.strip(), value


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tilewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--pools")
    p.add_argument("--root", type=setting, action="append", default=[])
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    x = sub.add_parser("index")
    x.add_argument("spec")
    x.add_argument("out")
    x.add_argument("--boxes")
    x.add_argument("--detector")
    x.add_argument("--set", type=setting, action="append", default=[])
    x.add_argument("--force", action="store_true")
    for name, kind, default in (("--limit", int, None), ("--stride", int, 1), ("--seed", int, None), ("--min-score", float, 0.0), ("--min-side", float, 8.0), ("--max-per-frame", int, None)):
        x.add_argument(name, type=kind, default=default)
    for name in ("stats", "dump", "check"):
        y = sub.add_parser(name)
        y.add_argument("index")
        if name == "dump":
            y.add_argument("file")
            y.add_argument("--form", choices=("path", "name", "stem"), default="path")
            y.add_argument("--limit", type=int)
        if name == "check":
            y.add_argument("width", type=float)
            y.add_argument("height", type=float)
    g = sub.add_parser("generate")
    g.add_argument("index")
    g.add_argument("spec")
    g.add_argument("--seed", type=int, default=0)
    z = sub.add_parser("augment")
    z.add_argument("--set", type=setting, action="append", default=[])
    z.add_argument("--seeds", type=int, default=16)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .operators import checks, corruptions, detectors, lifecycle, rasters
    from .operators.augment import Augmenter
    from .sources import boxes_json, pools

    if args.pools:
        with open(args.pools, encoding="utf-8") as f:
            pools.configure(json.load(f), dict(args.root))
    if args.command == "list":
        print(json.dumps({"detectors": detectors.DETECTORS.notes(), "ops": corruptions.KINDS.notes(), "pools": pools.available()}, indent=1))
        return 0
    if args.command == "augment":
        said = checks.augmenter_problems(Augmenter(dict(args.set) or None), rasters.synthetic_frame(), (139.0, 124.0, 183.0, 140.0), range(args.seeds))
        print("\n".join(said) or "no problem")
        return int(bool(said))
    spark = session()
    if args.command == "index":
        thresholds = {"min_score": args.min_score, "min_side": args.min_side, "max_per_frame": args.max_per_frame}
        lifecycle.load_or_build(spark, args.out, lambda: _indexed(spark, args, thresholds), args.force, **thresholds)
        return 0
    index = lifecycle.load(spark, args.index)
    if args.command == "stats":
        print(json.dumps(lifecycle.describe(index), indent=1))
        return 0
    if args.command == "dump":
        rows = index.by_path()
        boxes_json.write(rows if args.limit is None else rows.orderBy("frame_ord").limit(args.limit), args.file, index.meta, args.form)
        return 0
    if args.command == "generate":
        return _checked(spark, args, index)
    found = checks.detection_violations(index.examples.withColumnRenamed("n", "ord"), args.width, args.height)
    n = found.count()
    for r in found.orderBy("path", "ord", "rule").limit(100).collect():
        print(f"{r.path} #{r.ord}: {r.rule}")
    print("no problem" if not n else f"{n} problems" + (", the first 100 of them above" if n > 100 else ""))
    return int(n > 0)


def _indexed(spark, args, thresholds: dict):
    """An index by the detector asked for: a box file's, or one from pixels."""
    from .operators import detectors, lifecycle, ordering
    from .sources import boxes_json, images, pools

    frames = ordering.pool_sample(pools.scan(spark, args.spec), args.stride, args.limit, args.seed)
    if not frames.take(1):
        raise FileNotFoundError(args.spec)
    name = args.detector or ("precomputed" if args.boxes else pools.suggested_detector(args.spec))
    options = dict(args.set) | ({"records": boxes_json.read(spark, args.boxes)} if args.boxes else {})
    detector = detectors.build(name, **options) if not name.startswith("fn:") else detectors.FunctionDetector(_function(name[3:]), **options)
    if isinstance(detector, detectors.FunctionDetector):
        frames = frames.join(images.frames(spark, args.spec), "path")
    made, failed = lifecycle.build(frames, detector, meta={"source": pools.source_name(args.spec), "limit": args.limit, "stride": args.stride}, **thresholds)
    if "image" in frames.columns:
        print(f"{failed.count()} frames failed", file=sys.stderr)
    return made


def _function(name: str):
    import pkgutil

    return pkgutil.resolve_name(name)


def _checked(spark, args, index) -> int:
    from pyspark.sql import functions as F

    from .operators import checks
    from .operators.generate import PairSource
    from .sources import images

    source = PairSource(index, images.split_errors(images.frames(spark, args.spec))[0], seed=args.seed)
    keys = lambda e: source.epoch(e).select("pos", "idx", F.md5("pair.clean").alias("clean_key"), F.md5("pair.doctored").alias("pair_key"))
    said = [f"epoch {r.epoch}: {r.rule}" for r in checks.generator_problems(keys, len(source)).collect()]  # a row or two for each rule
    print("\n".join(said) or "no problem")
    return int(bool(said))


if __name__ == "__main__":
    sys.exit(main())
