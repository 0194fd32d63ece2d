"""A whole run: what is left of the questions, two passes of generation, records, submission."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.config import RunConfig
from marginalia.functions import free, prompts
from marginalia.functions.letters import labels, primary_letter, risk_signal
from marginalia.generate import Generator, generate, stub
from marginalia.operators import guess, selection
from marginalia.session import checkpoint


def answer(questions: DataFrame, done: DataFrame | None, config: RunConfig = RunConfig(), make: Callable[[], Generator] = stub) -> DataFrame:
    """Records of the questions that `done` lacks: id, is_mcq, response, raw, path.

    Multiple-choice questions whose first text gives no letter, and the riskiest of
    each batch, get a second pass that only reads the letter from the first text.
    """
    q = questions.select("id", "question", "options", (F.coalesce(F.size("options"), F.lit(0)) > 0).alias("is_mcq"))
    q = selection.capped_by_kind(q, "is_mcq", {True: config.limit_mcq, False: config.limit_free}, config.seed)
    if done is not None:
        q = selection.remaining(q, done)
    mcq, frq = q.where("is_mcq"), q.where("not is_mcq")
    first = generate(mcq.select("id", prompts.mcq_prompt(F.col("question"), F.col("options")).alias("prompt")), make)
    x = mcq.join(first, "id").withColumn("valid", labels(F.col("options")))
    p = primary_letter(F.col("raw"), F.col("raw"), F.col("valid"))
    x = x.withColumn("letter", p["letter"]).withColumn("path", p["path"]).withColumn("score", risk_signal(F.col("raw"), F.col("valid"))["score"])
    x = checkpoint(selection.verify_budget(selection.batched(x, "id", config.batch_mcq), "id", "letter", "score", config.verify_share, config.verify_least))
    again = x.where("forced")
    second = generate(again.select("id", finalizer_prompt().alias("prompt")), make).select("id", F.col("raw").alias("final"))
    late = guess.guessed(again.join(second, "id"), "raw", "raw", "final", "valid", "options").select("id", "is_mcq", "raw", "guess.letter", "guess.path")
    choice = x.where("not forced").select("id", "is_mcq", "raw", "letter", "path").unionByName(late).select("id", "is_mcq", free.box(F.col("letter")).alias("response"), "raw", "path")
    text = generate(frq.select("id", prompts.free_prompt(F.col("question")).alias("prompt")), make)
    c = free.canonical_free(F.col("raw"), F.col("question"))
    rest = frq.join(text, "id").select("id", "is_mcq", c["response"].alias("response"), "raw", c["path"].alias("path"))
    return choice.unionByName(rest)


def finalizer_prompt():
    """Asks for nothing but the letter that a text chose."""
    return F.concat(
        F.lit("Do not solve this question. Only extract a letter from the raw output.\n\nQuestion:\n"), F.col("question"),
        F.lit("\n\nOptions:\n"), prompts.option_lines(F.col("options")), F.lit("\n\nValid choices: ["), F.array_join("valid", ", "),
        F.lit("].\n\nRaw model output to extract from:\n"), F.col("raw"), F.lit("\n\nReturn exactly one boxed letter: \\boxed{X}, where X is one valid choice."),
    )
