"""python -m vellum.plans.cli FOLDER: reviews every manuscript under a folder.

Ends with 0, or 3 if something could not be told, or 4 if --gate is given and something blocks a
submission; 1 on an error, 2 on wrong arguments, 130 if interrupted.
"""

from __future__ import annotations

import argparse
import os
import shlex
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.operators import judging, lookups, submission
from vellum.sources import pdf, probing, tables

from . import engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellum", description="Reviews manuscripts.")
    p.add_argument("folder", help="TeX sources with their bibliographies and checklists")
    p.add_argument("--out", default="reviews", help="folder for the reviews; earlier versions stay")
    p.add_argument("--authors", help="surnames to look for in prose, comma-separated")
    p.add_argument("--venue", help="id in --venue-rules")
    p.add_argument("--venue-rules", help="JSON lines with a venue's rules")
    p.add_argument("--abstract-baseline", help="folder of recorded abstracts; new ones are added")
    p.add_argument("--no-checklist", action="store_true")
    p.add_argument("--no-anonymize", action="store_true")
    p.add_argument("--no-numeric", action="store_true")
    p.add_argument("--checklist", help="name of the checklist's file, beside each source, or a path")
    p.add_argument("--pdf", action="store_true", help="review the PDF files under the folder too")
    p.add_argument("--online", action="store_true", help="ask the scholarly sources, probe links and artifacts, fetch cited works")
    p.add_argument("--mailto", help="e-mail address that some sources want")
    p.add_argument("--records", help="folder of records found before; new ones are added")
    p.add_argument("--verdicts", help="folder of verdicts given before; new ones are added")
    p.add_argument("--writer", help="command that answers a prompt on its input, for verdicts and prose")
    p.add_argument("--rating", action="store_true", help="show the writer's rating")
    p.add_argument("--gate", action="store_true", help="end with 4 if a paper has a blocker")
    for name in engine.EMPTY:
        p.add_argument(f"--{name.replace('_', '-')}", help=f"parquet of {name}: {engine.EMPTY[name]}")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vellum").getOrCreate()
    try:
        m = tables.manuscripts(spark, args.folder, args.checklist)
        if args.pdf:
            m = m.unionByName(pdf.read_pages(spark, args.folder), allowMissingColumns=True)
        m = m.withColumn("venue_id", F.lit(args.venue)).withColumn("authors", F.lit(args.authors))
        if args.no_checklist:
            m = m.withColumn("checklist_text", F.lit(None).cast("string"))
        given = {n: spark.read.schema(s).parquet(getattr(args, n)) for n, s in engine.EMPTY.items() if getattr(args, n)}
        if args.abstract_baseline:
            given["baseline"] = spark.read.schema(engine.EMPTY["baseline"]).parquet(args.abstract_baseline)
        rules = spark.read.schema(submission.VENUE_SCHEMA).json(args.venue_rules) if args.venue_rules else None
        skip = [f for f, no in (("anonymization", args.no_anonymize), ("numeric", args.no_numeric)) if no]
        probing.load_env([".", args.folder], ["VELLUM_MAILTO"])
        inputs = engine.Inputs(given, venue_rules=rules, gate=args.gate, skip=skip, show_rating=args.rating, email=args.mailto or os.environ.get("VELLUM_MAILTO"))
        if args.online:
            inputs.ask, inputs.send = lookups.live(), probing.http
        if args.writer:
            inputs.writer, inputs.model = judging.command(shlex.split(args.writer)), args.writer
        inputs.store = tables.read_store(spark, args.records, "cache_key") if args.records else None
        inputs.verdicts = tables.read_store(spark, args.verdicts, "verification_key") if args.verdicts else None
        result = engine.run(m, inputs)
        tables.write_reviews(result["reviews"], args.out)
        if args.abstract_baseline:
            result["new_baselines"].write.mode("append").parquet(args.abstract_baseline)
        for folder, table in ((args.records, "new_records"), (args.verdicts, "new_verdicts")):
            if folder and table in result:
                tables.append_store(result[table], folder)
        worst = result["exit_codes"].agg(F.max("exit_code")).first()[0] or 0
        if worst == 4:
            for r in result["gate_blockers"].limit(100).collect():
                print(f"{r.paper_id}: {'; '.join(r.blockers)}", file=sys.stderr)
        print(args.out)
        return worst
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"vellum: failed: {type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
