"""Command line: rewrite Word packages with Spark.

    python -m veil input.docx -o output.docx
    python -m veil folder -o folder-of-results --no-verify

The input is one package or a folder of them, in any store that Spark reads.  Exit codes: 0
done, 1 bad input, 2 no such model, 3 a real value survived; nothing is written then.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veil import __version__
from veil.functions.lexicon import PII_TYPES
from veil.operators.model import ModelUnavailable
from veil.operators.rules import Config
from veil.operators.verify import LeakDetected
from veil.plans.engine import Engine
from veil.sources import docx, reports
from veil.store import cut

OK, BAD_INPUT, NO_MODEL, LEAK = range(4)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veil", description="Replace personal data in Word packages by realistic surrogates.")
    p.add_argument("input", help="a package, or a folder of them")
    p.add_argument("-o", "--output", help="the new package, or a folder for them; not needed with --dump-text or --dry-run")
    p.add_argument("--types", help="types to look for, with commas between (default: all)")
    p.add_argument("--no-ner", action="store_true", help="rules alone")
    p.add_argument("--ner-model", help="name of a model")
    p.add_argument("--ner-agreement", action="store_true", help="names and firms of the model must also look like ones")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--reference-numbers", action="store_true", help="take numbers that are labelled as references for personal data too")
    p.add_argument("--report", help="folder for JSON reports; they undo the rewriting")
    p.add_argument("--dry-run", action="store_true", help="count, and write nothing")
    p.add_argument("--dump-text", action="store_true", help="print the text and stop")
    p.add_argument("--no-verify", action="store_true", help="skip the checks")
    p.add_argument("-v", "--verbose", action="count", default=0)
    return p


def types_of(raw: str | None) -> tuple[str, ...]:
    if raw is None or not raw.strip():
        return tuple(PII_TYPES)
    names = [x.strip() for x in raw.split(",") if x.strip()]
    if not names:
        raise ValueError("--types names no type")
    return tuple(dict.fromkeys(names))


def config_of(args: argparse.Namespace) -> Config:
    return Config(
        enabled_types=types_of(args.types), seed=args.seed, model=None if args.no_ner else args.ner_model, agreement=args.ner_agreement,
        let_reference_numbers_through=args.reference_numbers, verify_output=not args.no_verify)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    single = args.input.endswith(".docx")
    packages = docx.load(spark, args.input).withColumn("doc_id", F.xxhash64("path"))
    if not packages.take(1):
        raise docx.PackageError(f"no package at {args.input}")
    if args.dump_text:
        for r in docx.opened(packages).select("text", "error").toLocalIterator():
            if r["error"]:
                raise docx.PackageError(r["error"])
            print(r["text"], end="" if r["text"].endswith("\n") else "\n")
        return OK
    if not args.output and not args.dry_run:
        raise ValueError("--output is needed without --dump-text or --dry-run")
    if args.output and os.path.abspath(args.output) == os.path.abspath(args.input):
        raise ValueError("the output is the input")
    began, config = time.time(), config_of(args)
    engine = Engine(config)
    done = cut(engine.rewrite_packages(packages))
    if bad := done.where("error is not null").select("error").first():
        raise docx.PackageError(bad[0])
    engine.verify(done)
    counts = done.select(F.explode("counts_by_type").alias("pii_type", "n")).groupBy("pii_type").agg(F.sum("n").alias("n")).orderBy("pii_type").collect()  # ten types
    for r in counts:
        print(f"  {r['pii_type']}: {r['n']}")
    if not counts:
        print("  (no replacements)")
    print(f"total: {sum(r['n'] for r in counts)}")
    if not args.dry_run:
        docx.register(spark)
        folder = os.path.dirname(os.path.abspath(args.output)) if single else args.output
        name = F.lit(os.path.basename(args.output)) if single else F.element_at(F.split("path", "/"), -1)
        done.select(name.alias("name"), F.col("saved").alias("content")).write.format("docx").mode("append").save(folder)
        print(f"output: {args.output}")
    if args.report:
        reports.run_report(done, __version__, config.seed).select("report").write.mode("overwrite").text(args.report)
    print(f"elapsed: {time.time() - began:.3f}s")
    return OK


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("veil").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if spark is None:
        session.sparkContext.setLogLevel(("ERROR", "WARN", "INFO")[min(args.verbose, 2)])
    try:
        return run(session, args)
    except ModelUnavailable as e:
        code, said = NO_MODEL, e
    except LeakDetected as e:
        code, said = LEAK, e
    except Exception as e:  # noqa: BLE001: whatever fails, the caller sees no success
        code, said = BAD_INPUT, e
    print(str(said).splitlines()[0][:300], file=sys.stderr)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
