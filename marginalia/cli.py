"""Command lines: answer a set of questions, or build a training set from answered ones."""

from __future__ import annotations

import argparse
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marginalia import artifacts, run
from marginalia.config import PRESETS, STAGE_RATE, RunConfig, TrainConfig, optional_text, project_root, resolve_input
from marginalia.operators import curate, selection
from marginalia.session import local_session
from marginalia.sources import jsonl, sinks


def _cap(value: str) -> int | None:
    """A cap; 0 and none are no cap."""
    n = int(optional_text(value) or 0)
    return n or None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("answer", help="answer questions in batches that can stop and go on")
    a.add_argument("--input", default="private", help="private, public, or a path")
    a.add_argument("--output", required=True)
    a.add_argument("--done", type=optional_text, default=None, help="records of an earlier run")
    a.add_argument("--limit-mcq", type=_cap, default=None)
    a.add_argument("--limit-free", type=_cap, default=None)
    a.add_argument("--sample-seed", type=int, default=0)
    a.add_argument("--batch-mcq", type=int, default=12)
    a.add_argument("--batch-free", type=int, default=2)
    a.add_argument("--verify-share", type=float, default=0.25)
    t = sub.add_parser("train-set", help="examples, held-out rows and manifest of a stage")
    t.add_argument("--input", default="public")
    t.add_argument("--output", required=True)
    t.add_argument("--stage", choices=sorted(STAGE_RATE), default="adapt")
    t.add_argument("--preset", choices=["none", *PRESETS], default="none")
    t.add_argument("--holdout", type=float, default=None)
    t.add_argument("--seed", type=int, default=0)
    t.add_argument("--full-texts", action="store_true")
    t.add_argument("--keep-style", action="store_true")
    t.add_argument("--mcq-weight", type=float, default=1.0)
    return p


def answer(spark: SparkSession, o: argparse.Namespace, root: Path) -> None:
    config = RunConfig(o.input, o.limit_mcq, o.limit_free, o.sample_seed, o.batch_mcq, o.batch_free, o.verify_share)
    questions = jsonl.questions(jsonl.tolerant(jsonl.lines(spark, str(resolve_input(o.input, root)))))
    done = jsonl.done_ids(jsonl.lines(spark, o.done)) if o.done else None
    records = run.answer(questions, done, config)
    sinks.write_ordered_json(records, f"{o.output}/{config.stem}_outputs")


def train_set(spark: SparkSession, o: argparse.Namespace, root: Path) -> dict:
    config = replace(TrainConfig(o.stage, holdout=o.holdout, full_texts=o.full_texts, final_answer_only=not o.full_texts).with_preset(o.preset).with_stage_defaults(), weights={"mcq": o.mcq_weight})
    q = jsonl.questions(jsonl.tolerant(jsonl.lines(spark, str(resolve_input(o.input, root))))).where("answer is not null")
    q = q.withColumn("answer", F.array_join("answer", ", "))
    kept = artifacts.write_holdout(selection.with_holdout(q, config.holdout or 0.0, o.seed), f"{o.output}/holdout")
    x = curate.adapt_examples(kept, config.full_texts, config.final_answer_only, o.keep_style).withColumn("source", F.lit("competition_adapt"))
    x = x.withColumn("reason", F.when(F.col("target").isNull(), "no_usable_answer"))
    good = x.where("reason is null").drop("reason")
    selection.weighted(good, "kind", F.when(F.col("kind") == "mcq", o.mcq_weight).otherwise(1.0), o.seed, "id").write.mode("overwrite").json(f"{o.output}/examples")
    return artifacts.write_manifest(Path(o.output) / "train_config.json", config, x)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, root: Path | None = None) -> None:
    o = parser().parse_args(argv)
    do = {"answer": answer, "train-set": train_set}[o.command]
    do(spark or local_session(), o, root or project_root(Path.cwd()))


if __name__ == "__main__":
    main()
