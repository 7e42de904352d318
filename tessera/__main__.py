"""python -m tessera: the operators of the review loop from a command line. Tables are Parquet; a changed table is a new snapshot in ``--out``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tessera import sources
from tessera.operators import evaluate, review

FEATURES = ["pro_match", "anti_match", "competing", "rule_conflict", "confidence"]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    sub = out.add_subparsers(dest="command", required=True)
    for name, options in {
        "ingest": ("folder", "known", "out"), "link": ("items", "predictions", "out"), "review": ("items", "out"), "correct": ("items", "answers", "out"), "reject": ("items", "answers", "out"),
        "stats": ("items",), "export": ("items", "out"), "evaluate": ("rows",), "train": ("log", "out"), "migrate": ("log", "out"), "queue": ("log",),
    }.items():
        p = sub.add_parser(name)
        for o in options:
            p.add_argument(f"--{o}", required=True)
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """The frame a command shows; those that change a table write it first."""
    load = lambda name: spark.read.parquet(getattr(args, name))

    def keep(df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").parquet(args.out)
        return spark.read.parquet(args.out)

    match args.command:
        case "ingest":
            files, known = sources.files_of(spark, args.folder), load("known")
            keep(sources.ingest(files, known))
            return sources.ingest_counts(files, known)
        case "link":
            return review.link_counts(keep(review.link_predictions(load("items"), load("predictions"))))
        case "review":
            return keep(review.auto_review(load("items")))
        case "correct":
            return keep(review.correct(load("items"), load("answers")))
        case "reject":
            return keep(review.reject(load("items"), load("answers")))
        case "stats":
            return review.item_stats(load("items"))
        case "export":
            return sources.export(load("items"), args.out)
        case "evaluate":
            return evaluate.score(load("rows"), ["file"], rollup=True)
        case "train":
            weights = evaluate.fit_calibration(review.training_rows(load("log")), FEATURES)
            if weights is None:
                return None
            return spark.createDataFrame([(sources.save_weights(spark, weights, args.out),)], "path string")
        case "migrate":
            return keep(review.evolve(load("log")))
        case "queue":
            return review.queue(load("log"))


def main() -> None:
    args = parser().parse_args()
    shown = run(SparkSession.builder.appName("tessera").getOrCreate(), args)
    if shown is None:
        raise SystemExit("too few reviewed rows, or rows of one class alone")
    shown.show(truncate=False)


if __name__ == "__main__":
    main()
