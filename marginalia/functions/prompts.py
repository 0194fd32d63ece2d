"""Prompts as Column expressions. The example shown before a question is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.free import ans_slots
from marginalia.functions.letters import labels
from marginalia.functions.text import strip

# The sentences of the prompts.
MCQ_TASK = "Think step by step, but keep it concise. Compare the options and choose the best answer. End with exactly one boxed option letter like \\boxed{A}. Do not output anything after the boxed letter."
MCQ_TRAIN_TASK = "Output exactly one final boxed letter like \\boxed{A}. Do not output option text and do not output multiple boxed answers."
MCQ_STRICT_TASK = "Think briefly and choose the correct option. End with exactly one boxed letter."
REASONING_TASK = "Show concise step-by-step reasoning, then provide exactly one final \\boxed{...} answer."
FREE_TRAIN_TASK = "Output exactly one final \\boxed{...} answer and do not include more than one box."


def option_lines(options: Column, trimmed: bool = True) -> Column:
    text = F.transform(options, lambda o: strip(F.coalesce(o, F.lit("None"))) if trimmed else F.coalesce(o, F.lit("None")))
    return F.array_join(F.zip_with(labels(options), text, lambda l, o: F.concat(l, F.lit(". "), o)), "\n")


def mcq_prompt(question: Column, options: Column, task: str = MCQ_TASK, example: str = "") -> Column:
    return F.concat(F.lit(example + "Q: "), question, F.lit("\n\nOptions:\n"), option_lines(options), F.lit("\n\nValid choices: ["), F.array_join(labels(options), ", "), F.lit("].\n" + task))


def strict_mcq_prompt(question: Column, options: Column) -> Column:
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nOptions:\n"), option_lines(options, trimmed=False), F.lit("\n\n" + MCQ_STRICT_TASK))


def slot_task(question: Column) -> Column:
    n = ans_slots(question).cast("string")
    return F.concat(F.lit("This question has "), n, F.lit(" answer slots. Output exactly "), n, F.lit(" values, in order and comma-separated, inside one final \\boxed{...}."))


def free_prompt(question: Column) -> Column:
    return F.when(ans_slots(question) >= 2, F.concat(question, F.lit("\n\n"), slot_task(question))).otherwise(question)


def free_train_prompt(question: Column) -> Column:
    return F.concat(question, F.lit("\n\n"), F.when(ans_slots(question) >= 2, slot_task(question)).otherwise(F.lit(FREE_TRAIN_TASK)))


def reasoning_prompt(question: Column) -> Column:
    return F.concat(question, F.lit("\n\n" + REASONING_TASK))


def chat(system: Column, user: Column, thinking: bool = True) -> Column:
    """A conversation in the ChatML form, open for the assistant."""
    turn = lambda role, text: F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>\n"))
    u = user if thinking else F.concat(user, F.lit(" /no_think"))
    return F.concat(turn("system", system), turn("user", u), F.lit("<|im_start|>assistant\n"))
