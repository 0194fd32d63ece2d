"""Training examples from answered questions and generated texts: cascades that name the reason of every refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.artifacts import check_replay_schema
from marginalia.functions import free, letters, prompts, quality
from marginalia.functions.boxed import extract_all_boxed
from marginalia.functions.text import first_filled, last_of, strip

# What the parts of a training text are told, by example.
SYSTEM_REASONING = "You are an expert competition mathematician. Provide concise step-by-step reasoning and finish with exactly one final \\boxed{...}."
SYSTEM_REPLAY = "You are solving competition math questions. Preserve stable behavior and finish with exactly one final \\boxed{...}."
SYSTEM_REJECTION = "You are solving competition math questions. Provide concise reasoning and end with exactly one final \\boxed{...}."
SYSTEM_ADAPT = "You are solving competition math questions. Follow the required output format and end with exactly one final \\boxed{...}."
SYSTEM_ADAPT_STYLE = "You are solving competition math questions. Keep reasoning style stable and avoid copying training-template wording. End with exactly one final \\boxed{...}."
LEAD_MCQ, LEAD_FREE = "Compute the answer and compare to options carefully.\nFinal answer: ", "Solve the problem concisely and report only one final boxed answer.\n"
LEAST_TARGET, LEAST_TRACE, LEAST_TOKENS = 60, 40, 32


def clean_options(options: Column) -> Column:
    return F.filter(F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: strip(o)), lambda o: o.isNotNull() & (o != ""))


def answer_to_letter(answer: Column, options: Column, valid: Column) -> Column:
    """struct(letter, reason): a letter in any brackets, an index, a phrase, or the only option of that text."""
    t = strip(answer)
    compact = F.upper(strip(answer, r"()\[\]{}"))
    index = F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int"))
    phrase = letters.extract_valid_letter(t, valid)
    hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(options), F.lit(1)) - 1), lambda i: F.lower(strip(F.get(options, i))) == F.lower(t))
    out = lambda letter, reason: F.struct((letter if isinstance(letter, Column) else F.lit(letter)).alias("letter"), F.lit(reason).alias("reason"))
    return (
        F.when(F.size(valid) == 0, out("", "missing_options"))
        .when(answer.isNull(), out("", "missing_answer"))
        .when(t == "", out("", "empty_answer"))
        .when((F.length(compact) == 1) & F.array_contains(valid, compact), out(compact, ""))
        .when(t.rlike("^[0-9]+$"), F.when(index < F.size(options), out(F.char(index + 65), "")).otherwise(out("", "answer_index_out_of_range")))
        .when(phrase != "", out(phrase, ""))
        .when(F.size(hits) == 1, out(F.char(F.get(hits, F.lit(0)) + 65), ""))
        .when(F.size(hits) > 1, out("", "ambiguous_answer_text_duplicate_choice"))
        .otherwise(out("", "answer_unmapped"))
    )


def gold_letter(answer: Column, options: Column, valid: Column) -> Column:
    """The letter of a gold answer: by phrase, by the text of an option (the first), or itself; else ''."""
    t = strip(F.coalesce(answer, F.lit("")))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(options), F.lit(1)) - 1), lambda i: F.lower(strip(F.get(options, i))) == F.lower(t))
    phrase = letters.extract_valid_letter(t, valid)
    return F.when(t == "", "").when(phrase != "", phrase).when(F.size(at) > 0, F.char(F.get(at, F.lit(0)) + 65)).when(F.array_contains(valid, F.upper(t)), F.upper(t)).otherwise("")


def reasoning_examples(df: DataFrame, problem: str, solution: str, fallback: str) -> DataFrame:
    """Adds reason (null where accepted), prompt and target."""
    s = quality.normalize_solution(F.col(solution))
    x = df.withColumn("__s", s).withColumn("__flag", quality.quality_flag(F.col(problem), F.col("__s"))).withColumn("__t", free.single_final_box(F.col("__s"), F.col(fallback)))
    reason = F.coalesce(F.col("__flag"), F.when(F.length(strip(F.col("__t"))) < LEAST_TARGET, "target_too_short_after_canonicalize"))
    ok = reason.isNull()
    return x.withColumn("reason", reason).withColumn("prompt", F.when(ok, prompts.reasoning_prompt(F.col(problem)))).withColumn("target", F.when(ok, F.col("__t"))).drop("__s", "__flag", "__t")


def base_replay(df: DataFrame) -> DataFrame:
    """df: id, response, raw, meta, correct (or null), question, options, answer. Adds kind, reason, target: lines good enough to be repeated.

    A known verdict decides first; without one the form of the response must be clean. Letters must agree with the gold one.
    """
    m = F.col("meta")
    df = df.withColumn("__r", strip(F.coalesce("response", F.lit("")))).withColumn("__t", strip(F.coalesce(F.nullif("raw", F.lit("")), m["raw"], F.lit("")))).withColumn("__o", clean_options(F.col("options")))
    response, trace, options = F.col("__r"), F.col("__t"), F.col("__o")
    df = df.withColumn("__canon", quality.normalize_solution(trace)).withColumn("__b", extract_all_boxed(response)).withColumn("__v", letters.labels(options))
    canon, b, valid = F.col("__canon"), F.col("__b"), F.col("__v")
    mcq = F.coalesce("is_mcq", F.size(options) > 0)
    gold = F.when(F.coalesce("answer", F.lit("")) != "", gold_letter(F.col("answer"), F.col("options"), letters.labels(F.col("options")))).otherwise("")
    found = letters.extract_valid_letter(F.when(canon != "", canon).otherwise(response), valid)
    df = df.withColumn("__gold", gold).withColumn("__found", found)
    gold = F.col("__gold")
    letter = F.when(F.col("__found") != "", F.col("__found")).otherwise(gold)
    yes = lambda c: F.coalesce(m[c], F.lit(False))
    form = (
        F.when(F.size(b) == 0, "clean_filter_missing_box")
        .when(F.exists(b, lambda x: x == ""), "clean_filter_empty_boxed")
        .when(F.size(b) > 1, "clean_filter_multiple_boxed")
        .when(yes("malformed_output"), "clean_filter_malformed")
        .when(yes("generation_hit_max"), "clean_filter_truncated")
        .when(yes("guessed_letter_used"), "clean_filter_guessed_letter")
        .when(yes("fallback_used"), "clean_filter_fallback")
    )
    reason = F.coalesce(
        F.when((response == "") & (trace == ""), "missing_response"),
        F.when(F.col("correct").isNotNull(), F.when(~F.col("correct"), "marked_incorrect")).otherwise(form),
        F.when(strip(F.coalesce("question", F.lit(""))) == "", "missing_question_for_replay"),
        F.when(mcq, F.when(F.size(options) < 2, "missing_options_for_replay_mcq").when(letter == "", "invalid_replay_mcq_letter").when((gold != "") & (letter != gold), "replay_letter_mismatch_gold")).otherwise(F.when(F.coalesce(last_of(b), F.lit("")) == "", "invalid_replay_frq_boxed")),
    )
    target = free.box(F.when(mcq, letter).otherwise(F.coalesce(last_of(b), F.lit(""))))
    return df.withColumn("kind", F.when(mcq, "mcq").otherwise("frq")).withColumn("reason", reason).withColumn("target", F.when(F.col("reason").isNull(), target)).drop("__r", "__t", "__o", "__canon", "__b", "__v", "__gold", "__found")


def rejection_replay(df: DataFrame) -> DataFrame:
    """df: filter_passed, question, options, and the trace as accepted_raw, raw or response. Adds kind, reason, target. Rows of another schema are refused as a whole."""
    check_replay_schema(df)
    df = df.withColumn("__raw", first_filled(F.col("accepted_raw"), F.col("raw"), F.col("response"))).withColumn("__canon", quality.normalize_solution(F.col("__raw")))
    raw, canon = F.col("__raw"), F.col("__canon")
    df = df.withColumn("__b", extract_all_boxed(canon)).withColumn("__flag", quality.quality_flag(F.col("question"), canon))
    b, flag = F.col("__b"), F.col("__flag")
    options = clean_options(F.col("options"))
    mcq = F.size(options) > 0
    letter = letters.extract_valid_letter(canon, letters.labels(options))
    reason = (
        F.when(~F.coalesce("filter_passed", F.lit(False)), "filter_not_passed")
        .when(strip(F.coalesce("question", F.lit(""))) == "", "missing_question")
        .when(raw.isNull(), "missing_accepted_raw")
        .when(canon == "", "empty_after_normalize")
        .when((F.size(b) != 1) | (F.coalesce(last_of(b), F.lit("")) == ""), "invalid_boxed_shape")
        .when(flag.isNotNull() & ~(mcq & (flag == "multiple_boxed_in_solution")), flag)
        .when(mcq & (F.size(options) < 2), "missing_options_for_mcq")
        .when(mcq & (letter == ""), "missing_or_invalid_mcq_letter")
    )
    return df.withColumn("kind", F.when(mcq, "mcq").otherwise("frq")).withColumn("reason", reason).withColumn("target", F.when(F.col("reason").isNull(), free.single_final_box(canon, F.lit("")))).drop("__raw", "__canon", "__b", "__flag")


def adapt_examples(df: DataFrame, full_texts: bool = False, final_answer_only: bool = True, keep_style: bool = False) -> DataFrame:
    """df: id, question, options, answer. Questions with their final answer (led in by a sentence, where whole texts are asked for); those without a usable one have a null target. keep_style: tells the model to keep its way of reasoning."""
    mcq = F.coalesce(F.size("options"), F.lit(0)) > 0
    letter = gold_letter(F.col("answer"), F.col("options"), letters.labels(F.col("options")))
    free_ = strip(F.coalesce("answer", F.lit("")))
    value = F.when(mcq, letter).otherwise(free_)
    prompt = F.when(mcq, prompts.mcq_prompt(F.col("question"), F.col("options"), prompts.MCQ_TRAIN_TASK)).otherwise(prompts.free_train_prompt(F.col("question")))
    target, kind = free.box(value), F.lit("final_answer_only")
    if not final_answer_only:
        kind = F.when(mcq, "letter_only").otherwise("real_reasoning")
        if full_texts:
            target = F.concat(F.when(mcq, LEAD_MCQ).otherwise(LEAD_FREE), target)
    ok = value != ""
    system = F.lit(SYSTEM_ADAPT_STYLE if keep_style else SYSTEM_ADAPT)
    return df.where("answer is not null").select("id", F.when(mcq, "mcq").otherwise("frq").alias("kind"), F.when(ok, prompt).alias("prompt"), F.when(ok, target).alias("target"), system.alias("system_prompt"), F.when(ok, kind).alias("target_kind"))


def skip_reasons(examples: DataFrame, by: str) -> DataFrame:
    """Rows loaded, accepted and refused by reason."""
    return examples.groupBy(by, F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n_rows"))
