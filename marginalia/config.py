"""Settings of runs and of training sets: data, not control flow."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

# What the presets of a training set switch on, cap and weigh.
PRESETS: dict[str, dict[str, dict[str, float]]] = {
    "fast_pilot": {
        "caps": {"metamathqa": 2000, "numinamath": 2000, "openmath": 1500, "orca": 3000},
        "weights": {"metamathqa": 1.0, "numinamath": 1.0, "openmath": 1.0, "orca": 0.8},
        "most_steps": {"mcq": 120, "mixed_reasoning_mcq": 120, "rejection_sft": 120, "": 180},
    },
    "one_day_full": {
        "caps": {"metamathqa": 8000, "numinamath": 8000, "openmath": 6000, "hendrycks": 5000, "orca": 30000, "ultrainteract": 12000},
        "weights": {"metamathqa": 1.2, "numinamath": 1.2, "openmath": 1.1, "hendrycks": 1.0, "orca": 1.0, "ultrainteract": 0.7, "base_replay": 1.1, "rejection_replay": 1.3},
        "most_steps": {"mcq": 220, "mixed_reasoning_mcq": 220, "rejection_sft": 220, "": 400},
    },
}
# Which kinds of examples a stage keeps.
STAGE_KINDS = {"reasoning": ("frq",), "mcq": ("mcq",), "mixed_reasoning_mcq": ("frq", "mcq"), "rejection_sft": ("frq", "mcq"), "adapt": ("frq", "mcq")}
DEFAULT_REASONING = ("metamathqa", "numinamath", "orca")
# Learning rates and steps that stages take where the settings still stand at their defaults, and the bridge's steps and weight.
RATE, STEPS = 2e-4, 500
STAGE_RATE = {"reasoning": 8e-5, "mcq": 1e-5, "mixed_reasoning_mcq": 1e-5, "rejection_sft": 1e-5, "adapt": 1e-5}
STAGE_STEPS = {"reasoning": 1000, "mcq": 60, "mixed_reasoning_mcq": 1000, "rejection_sft": 60, "adapt": 60}
ADAPT_HOLDOUT, BRIDGE_WEIGHT, BRIDGE_STEPS = 0.3, 1.2, {"mcq": 160, "": 200}


@dataclass(frozen=True)
class RunConfig:
    """One inference run. Batches: questions of a kind that are generated together."""

    split: str = "private"
    limit_mcq: int | None = None
    limit_free: int | None = None
    seed: int = 0
    batch_mcq: int = 12
    batch_free: int = 2
    verify_share: float = 0.25
    verify_least: int = 2

    @property
    def stem(self) -> str:
        caps = [f"{k}{v}" for k, v in (("mcq", self.limit_mcq), ("free", self.limit_free)) if v is not None]
        return "_".join([self.split, *caps, f"seed{self.seed}"]) if caps else self.split


@dataclass(frozen=True)
class TrainConfig:
    """A training set's settings. caps: rows per source, 0 for all; holdout: None for the stage's own."""

    stage: str = "reasoning"
    caps: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    learning_rate: float = RATE
    most_steps: int = STEPS
    holdout: float | None = None
    full_texts: bool = False
    final_answer_only: bool = True
    bridge: bool = False
    rejection_path: str | None = None

    def with_preset(self, name: str) -> "TrainConfig":
        if name in ("", "none"):
            return self
        p = PRESETS[name]
        steps = int(p["most_steps"].get(self.stage, p["most_steps"][""]))
        return replace(self, caps=self.caps | {k: int(v) for k, v in p["caps"].items()}, weights=self.weights | p["weights"], most_steps=min(self.most_steps, steps))

    def with_stage_defaults(self) -> "TrainConfig":
        """What the stage sets where nothing else is asked for: sources, rate, steps, form of targets, rows held out."""
        if self.stage not in STAGE_RATE:
            raise ValueError(f"unknown stage {self.stage}")
        c = self
        if c.stage in ("reasoning", "mixed_reasoning_mcq") and not c.caps:
            c = replace(c, caps={n: 0 for n in DEFAULT_REASONING})
        if c.learning_rate >= RATE:
            c = replace(c, learning_rate=STAGE_RATE[c.stage])
        if c.most_steps == STEPS:
            c = replace(c, most_steps=STAGE_STEPS[c.stage])
        c = replace(c, full_texts=c.stage == "reasoning" or c.stage == "adapt" and c.full_texts and not c.final_answer_only)
        if c.stage == "rejection_sft":
            c = replace(c, caps={"rejection_replay": 0} | c.caps)
        if c.stage == "adapt" and c.holdout is None:
            c = replace(c, holdout=ADAPT_HOLDOUT)
        return c.with_bridge() if c.bridge and c.stage in ("mcq", "mixed_reasoning_mcq", "rejection_sft") else c

    def with_bridge(self) -> "TrainConfig":
        """A short stage between reasoning and choices: choice sources with a floor of weight, few steps."""
        more = ["math_mc", "compmath", *(["rejection_replay"] if self.rejection_path else [])]
        least = lambda k: max(self.weights.get(k, 1.0), BRIDGE_WEIGHT)
        steps = BRIDGE_STEPS["mcq" if self.stage == "mcq" else ""]
        few = steps if self.most_steps == STAGE_STEPS["mcq"] or self.most_steps > BRIDGE_STEPS[""] else self.most_steps
        return replace(self, caps={k: 0 for k in more} | self.caps, weights=self.weights | {"mcq": least("mcq"), "rejection_replay": least("rejection_replay")}, most_steps=few)


@dataclass(frozen=True)
class Sampling:
    """How texts are drawn. Greedy unless sample is set."""

    most_tokens: int = 12_288
    sample: bool = False
    temperature: float = 0.6
    top_p: float = 0.95
    top_k: int = 20
    repetition: float = 1.0
    no_repeat_ngram: int = 0
    seed: int | None = None
    least_tokens: int | None = None

    def settings(self, known: frozenset[str] | None = None) -> dict[str, float | int]:
        """Names and values for a generator; known: the names it takes (all, if not said), others are left out."""
        drawn = {"temperature": self.temperature, "top_p": self.top_p, "top_k": self.top_k if self.top_k > 0 else -1} if self.sample else {"temperature": 0.0, "top_p": 1.0, "top_k": -1}
        out = {"max_tokens": self.most_tokens, **drawn, "min_p": 0.0, "presence_penalty": 0.0, "repetition_penalty": self.repetition}
        if self.seed is not None:
            out["seed"] = int(self.seed)
        if self.no_repeat_ngram > 0:
            out["no_repeat_ngram_size"] = self.no_repeat_ngram
        least = min(int(self.least_tokens or 0), max(0, self.most_tokens - 1))
        if least > 0:
            out["min_tokens"] = least
        return {k: v for k, v in out.items() if known is None or k in known}


def resolve_input(name: str, root: Path) -> Path:
    """A split's file under data, or a path (relative to the root)."""
    if name in ("private", "public"):
        return root / "data" / f"{name}.jsonl"
    return Path(name) if Path(name).is_absolute() else root / name


def project_root(start: Path) -> Path:
    """The nearest ancestor that holds `data`, else the parent of the start."""
    return next((p for p in (start, *start.parents) if (p / "data").is_dir()), start.parent)


def optional_text(value: str | None) -> str | None:
    return None if value is None or value.strip().lower() in ("", "none", "null", "false") else value
