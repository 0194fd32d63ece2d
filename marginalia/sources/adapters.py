"""Sources whose columns have other names: each is a list of names to try, in order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import first_filled, strip

# Names under which sources keep question, solution and answer.
QUESTION = ("question", "problem", "prompt", "query")
SOLUTION = ("response", "solution", "generated_solution", "output", "assistant", "completion", "cot", "rationale", "explanation")
FINAL = ("expected_answer", "final_answer", "answer", "target", "label")
OPTIONS = ("options", "choices", "answer_choices")


@dataclass(frozen=True)
class Adapter:
    name: str
    question: tuple[str, ...] = QUESTION
    solution: tuple[str, ...] = SOLUTION
    final: tuple[str, ...] = FINAL
    options: tuple[str, ...] = OPTIONS
    keep: dict[str, tuple[str, ...]] = field(default_factory=dict)
    letters_first: bool = False  # a column for each letter goes before an array


ADAPTERS = {
    a.name: a
    for a in (
        Adapter("metamathqa"),
        Adapter("numinamath"),
        Adapter("openmath", ("problem",), ("generated_solution",), ("expected_answer",)),
        Adapter("hendrycks", ("problem",), ("solution",), ()),
        Adapter("orca", ("question",), ("answer",), ()),
        Adapter("ultrainteract", ("instruction",), ("response",), (), keep={"task": ("Math_Cot", "Math_PoT")}),
        Adapter("math_mc", options=("choices", *OPTIONS), letters_first=True),
        Adapter("compmath", ("question",), (), ("correct_label",), ("options",)),
    )
}


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(None).cast("string")
    if kind.startswith("array"):
        return F.array_join(F.filter(F.transform(F.col(name).cast("array<string>"), lambda x: strip(x)), lambda x: x != ""), ", ")
    return F.col(name).cast("string")


def options_of(df: DataFrame, a: Adapter) -> Column:
    """The options without blank ones: of columns by letter if two are filled, or of the first array that has any, in the adapter's order; null where there are none."""
    arrays = []
    for n in a.options:
        if dict(df.dtypes).get(n, "").startswith("array"):
            x = F.filter(F.transform(F.col(n).cast("array<string>"), lambda x: strip(x)), lambda x: x != "")
            arrays.append(F.when(F.size(x) > 0, x))
    by_letter = [strip(F.col(c).cast("string")) for c in "ABCDEFGHIJ" if c in df.columns]
    lettered = []
    if by_letter:
        x = F.filter(F.array(*by_letter), lambda x: x.isNotNull() & (x != ""))
        lettered.append(F.when(F.size(x) >= 2, x))
    found = lettered + arrays if a.letters_first else arrays + lettered
    return F.coalesce(*found, F.lit(None).cast("array<string>"))


def kept(df: DataFrame, a: Adapter) -> DataFrame:
    """The rows whose columns hold one of the values that the adapter keeps."""
    for c, values in a.keep.items():
        df = df.where(strip(F.col(c)).isin(*values))
    return df


def adapt(df: DataFrame, a: Adapter, more: tuple[str, ...] = ()) -> DataFrame:
    """source, question, solution, final_answer, options of any source. Rows outside `keep` go first, so caps count the rest."""
    df = kept(df, a)
    pick = lambda names: first_filled(*[_text(df, n) for n in names]) if names else F.lit(None).cast("string")
    return df.select(*more, F.lit(a.name).alias("source"), pick(a.question).alias("question"), pick(a.solution).alias("solution"), pick(a.final).alias("final_answer"), options_of(df, a).alias("options"))
