"""The command line: generate, analyze, demo, evaluate, ablate, tune, brief."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.scoring import Weights
from .plans import analysis, evaluation, report, tuning
from .sources import feedback, synthetic

LANGUAGE = {"team": "en", "canteen": "tr"}
PRESETS = {"balanced": Weights(), "revenue": Weights(0.15, 0.55, 0.15, 0.15), "volume": Weights(0.6, 0.0, 0.2, 0.2), "urgency": Weights(0.2, 0.2, 0.2, 0.4)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pulsemap", description=__doc__)
    does = p.add_subparsers(dest="command", required=True)
    for name in ("generate", "demo", "evaluate", "ablate", "tune", "brief"):
        c = does.add_parser(name)
        if name == "brief":
            c.add_argument("theme_id")
        c.add_argument("--scenario", default="team", choices=sorted(LANGUAGE))
        c.add_argument("--seed", type=int, default=7)
        c.add_argument("--days", type=int, default=synthetic.DAYS)
        if name in ("generate", "demo"):
            c.add_argument("--out", required=True)
        if name == "evaluate":
            c.add_argument("--json", help="also write the measures to this file")
    c = does.add_parser("analyze")
    c.add_argument("feedback", nargs="+")
    for option in ("--accounts", "--releases", "--as-of"):
        c.add_argument(option)
    c.add_argument("--out", required=True)
    c.add_argument("--language", default="en", choices=("en", "tr"))
    c.add_argument("--threshold", type=float, default=analysis.DISTANCE)
    c.add_argument("--preset", default="balanced", choices=sorted(PRESETS))
    c.add_argument("--product-name", action="append", default=[])
    c.add_argument("--briefs", type=int, default=3)
    c.add_argument("--no-redact", action="store_true")
    return p


def analyzed(spark: SparkSession, data: synthetic.Dataset, scenario: str) -> analysis.Analysis:
    accounts = None if data.accounts is None else feedback.load_accounts(data.accounts)
    return analysis.analyze(feedback.load_feedback(data.feedback), accounts, feedback.load_releases(data.releases), analysis.Config(language=LANGUAGE[scenario]))


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pulsemap").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "analyze":
        config = analysis.Config(language=o.language, distance_threshold=o.threshold, product_names=tuple(o.product_name), weights=PRESETS[o.preset], redact_pii=not o.no_redact)
        source = feedback.load_feedback(o.feedback[0], spark) if len(o.feedback) == 1 else feedback.combine_feedback({p: p for p in o.feedback}, spark)
        accounts, releases = o.accounts and feedback.load_accounts(o.accounts, spark), o.releases and feedback.load_releases(o.releases, spark)
        report.write_report(analysis.analyze(source, accounts, releases, config, o.as_of), o.out, o.briefs)
        return
    data = synthetic.generate(spark, o.scenario, o.seed, o.days)
    if o.command == "generate":
        data.save(o.out)
        return
    if o.command in ("ablate", "tune"):
        for row in tuning.compare(data, tuning.ABLATIONS if o.command == "ablate" else tuning.grid(), analysis.Config(language=LANGUAGE[o.scenario])):
            print(json.dumps(row))
        return
    a = analyzed(spark, data, o.scenario)
    if o.command == "brief":
        print(report.brief(report.evidence(a, o.theme_id)))
        return
    measures = evaluation.as_json(evaluation.evaluate_all(a, data))
    print(measures)
    if o.command == "demo":
        known = {f"{table}, {k}": v for table, rows in json.loads(measures).items() if len(rows) == 1 for k, v in rows[0].items()}
        report.write_report(a, o.out, measures=known)
    elif o.json:
        with open(o.json, "w") as f:
            f.write(measures)


if __name__ == "__main__":
    main()
