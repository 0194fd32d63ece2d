"""What stands beside a training set: kinds of targets, the manifest, held-out rows, folders of adapters."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import TrainConfig

# Kinds of targets and what they hold; names of an adapter's files; the least rank.
TARGET_KINDS = {
    "real_reasoning": "dataset reasoning field (real CoT)",
    "stub_rationale": "synthetic MCQ rationale stub (not real CoT)",
    "letter_only": "boxed letter only",
    "replay_raw_trace": "base replay JSONL raw trace (real CoT)",
    "final_answer_only": "final boxed answer only",
}
ADAPTER_CONFIG, ADAPTER_WEIGHTS, LEAST_RANK = "adapter_config.json", ("adapter_model.safetensors", "adapter_model.bin"), 16


def describe_target(kind: Column) -> Column:
    """What a kind of target holds; unknown kinds say so."""
    names = F.create_map(*[F.lit(x) for kv in TARGET_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, kind), F.lit("unknown"))


def mcq_target_kind(mode: Column, replay: Column) -> Column:
    """The kind of a multiple-choice target: a replayed text, a rationale where whole texts are asked for, else the letter."""
    return F.when(replay, "replay_raw_trace").when(mode == "full_trace", "stub_rationale").otherwise("letter_only")


def summary(examples: DataFrame, by: str = "source") -> list[dict]:
    """Per source: rows loaded, accepted and refused by reason. examples: `by`, reason (null where accepted)."""
    rows = examples.groupBy(by, "reason").agg(F.count("*").alias("n")).collect()  # sources x reasons
    out: dict[str, dict] = {}
    for r in rows:
        s = out.setdefault(r[by] or "(none)", {"loaded": 0, "accepted": 0, "skipped": {}})
        s["loaded"] += r["n"]
        if r["reason"] is None:
            s["accepted"] += r["n"]
        else:
            s["skipped"][r["reason"]] = r["n"]
    return [{"source": k, **out[k]} for k in sorted(out)]


def write_manifest(path: str | Path, config: TrainConfig, examples: DataFrame, by: str = "source", **more) -> dict:
    """Settings, counts per source and kind, and whatever else is given, as one JSON file with sorted keys."""
    kinds = {r[0]: r[1] for r in examples.where("reason is null").groupBy("kind").agg(F.count("*")).collect()}
    content = {**asdict(config), "sources": summary(examples, by), "final_mcq_count": kinds.get("mcq", 0), "final_frq_count": kinds.get("frq", 0), "final_total_count": sum(kinds.values()), **more}
    Path(path).write_text(json.dumps(content, indent=2, sort_keys=True))
    return content


def write_holdout(split: DataFrame, path: str) -> DataFrame:
    """Writes the rows held out as JSON lines and gives the others. split: rows with held_out."""
    split.where("held_out").drop("held_out").write.mode("overwrite").json(path)
    return split.where("not held_out").drop("held_out")


class SchemaError(ValueError):
    pass


def check_replay_schema(rows: DataFrame) -> None:
    """Raises unless the rows have what a replay of filtered texts needs: a question, the filter's word, and a text."""
    missing = sorted({"question", "filter_passed"} - set(rows.columns))
    if not {"accepted_raw", "raw_candidate", "raw", "response"} & set(rows.columns):
        missing.append("accepted_raw|raw_candidate|raw|response")
    if missing:
        raise SchemaError(f"missing {missing}, found {sorted(rows.columns)}")


def check_adapter(folder: str | Path) -> Path:
    """The folder, if it holds an adapter's settings and weights; else FileNotFoundError."""
    p = Path(folder).expanduser().resolve()
    if not p.is_dir():
        raise FileNotFoundError(f"no folder {p}")
    if not (p / ADAPTER_CONFIG).is_file():
        raise FileNotFoundError(f"{p} lacks {ADAPTER_CONFIG}")
    if not any((p / w).is_file() for w in ADAPTER_WEIGHTS):
        raise FileNotFoundError(f"{p} lacks {' or '.join(ADAPTER_WEIGHTS)}")
    return p


def adapter_rank(folder: str | Path | None = None, floor: int = LEAST_RANK) -> int:
    """The rank that an adapter asks for, but no less than the floor."""
    path = Path(folder) / ADAPTER_CONFIG if folder else None
    settings = json.loads(path.read_text()) if path and path.is_file() else {}
    return max(floor, int(settings.get("r", settings.get("lora_r")) or 0))
