"""Queries of evaluation: accuracy, the metric report, diagnostics and decisions between runs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import free, letters, quality
from marginalia.functions.boxed import extract_all_boxed, extract_boxed, extract_boxed_inner
from marginalia.functions.text import strip
from marginalia.judge.plan import judged
from marginalia.plans import duck
from marginalia.plans.duck import LAST, QUESTIONS, lit
from marginalia.plans.judging import _ANSWERED, answered, with_verdict
from marginalia.plans.relational import is_mcq, outputs, questions, records
from marginalia.plans.texts import _MCQ_LINES, mcq_lines
from marginalia.session import table

TOP_PATHS, TOP_RECOVERY, TOP_REASONS = 12, 8, 5


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Answered questions with the judge's verdict."""
    return with_verdict(answered(spark, d))


def exact(spark: SparkSession, d: str) -> DataFrame:
    """Answered questions with an exact verdict: the last box against the answer, case aside."""
    return answered(spark, d).withColumn("ok", F.lower("box") == F.lower("answer"))


def _rate(n, of):
    return F.round(F.coalesce(F.try_divide(n, of) * 100, F.lit(0.0)), 6)


def accuracy(x: DataFrame) -> DataFrame:
    """Per kind and over all, in one pass. x: mcq, ok."""
    y = x.groupingSets([["mcq"], []], "mcq").agg(F.count("*").alias("n_total"), F.count_if("ok").alias("n_correct"))
    return y.select(F.when(F.col("mcq").isNull(), "overall").when(F.col("mcq"), "mcq").otherwise("free").alias("kind"), "n_total", "n_correct", _rate(F.col("n_correct"), F.col("n_total")).alias("accuracy"))


def q_accuracy(spark, d):
    """Judged accuracy."""
    return accuracy(scored(spark, d).select("mcq", "ok"))


def q_exact_accuracy(spark, d):
    """Accuracy by exact texts."""
    return accuracy(exact(spark, d))


def _report_columns(valid):
    m = F.col("meta")
    b = extract_all_boxed(F.col("response"))
    raw = F.coalesce(F.nullif("raw", F.lit("")), m["raw"], F.lit(""))
    letter = letters.extract_valid_letter(F.col("response"), valid) != ""
    inner = extract_boxed_inner(raw)
    strict = (F.size(inner) == 1) & (F.coalesce(letters.letter_of_inner(F.try_element_at(inner, F.lit(1)), valid), F.lit("")) != "")
    yes = lambda c: F.coalesce(m[c], F.lit(False))
    signals = quality.reasoning_signals(F.when(raw != "", raw).otherwise(F.col("response")))
    mcq = F.col("mcq")
    diag = quality.diagnostics(raw, F.col("response"), mcq, valid, m["generation_hit_max"])
    low = yes("verify_triggered") & ~F.coalesce(m["verify_reason"].contains("no_primary_letter"), F.lit(False))
    one = extract_boxed_inner(F.col("response"))
    one_valid = (F.size(one) == 1) & (F.coalesce(letters.letter_of_inner(F.try_element_at(one, F.lit(1)), valid), F.lit("")) != "")
    flags = {
        "total": F.lit(True),
        "mcq_total": mcq,
        "free_total": ~mcq,
        "malformed_missing_box": F.size(b) == 0,
        "malformed_multiple_box": F.size(b) > 1,
        "malformed_invalid_mcq_letter": mcq & (F.size(b) > 0) & ~letter,
        "format_ok": (F.size(b) == 1) & (~mcq | letter),
        "raw_multi_boxed": F.coalesce(m["boxed_count_in_raw"], F.size(extract_boxed_inner(F.coalesce("raw", F.lit(""))))) > 1,
        "meta_malformed": yes("malformed_output"),
        "mcq_raw_strict_valid": mcq & strict,
        "mcq_recovered_valid": mcq & letter,
        "mcq_empty_boxed": mcq & F.exists(b, lambda x: x == ""),
        "mcq_invalid_boxed": mcq & (F.size(b) > 0) & ~one_valid,
        "mcq_repetition_loop": mcq & ((diag["repeats"] >= 2) | (diag["phrases"] >= 2)),
        "mcq_raw_boxed_gt1": mcq & (F.coalesce(m["boxed_count_in_raw"], F.lit(0)) > 1),
        "mcq_verify_low_confidence": mcq & low,
        "mcq_generation_hit_max": mcq & yes("generation_hit_max"),
        "mcq_finalizer_used": mcq & yes("finalizer_used"),
        "mcq_post_truncated": mcq & yes("raw_was_post_truncated"),
        "mcq_training_echo": mcq & yes("training_echo_detected"),
        "mcq_letter_recovered": mcq & yes("raw_letter_recovered"),
        "mcq_guessed": mcq & yes("guessed_letter_used"),
        "mcq_verify_triggered": mcq & yes("verify_triggered"),
        "mcq_verify_no_primary": mcq & yes("verify_triggered") & F.coalesce(m["verify_reason"].contains("no_primary_letter"), F.lit(False)),
    }
    for k in ("steps", "math", "surface_only"):
        flags[f"mcq_{k}"], flags[f"free_{k}"] = mcq & signals[k], ~mcq & signals[k]
    return flags


def q_metric_report(spark, d):
    """All counters in one aggregation, then one row per metric."""
    x = answered(spark, d).withColumn("valid", letters.labels(F.col("options")))
    flags = _report_columns(F.col("valid"))
    wide = x.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in flags])).alias("m")).select("m.metric", "m.n")


def q_verify_averages(spark, d):
    """Averages of tokens and of verification scores over judged multiple-choice lines, with their sums and counts."""
    m = F.col("meta")
    tokens, score = F.coalesce(m["n_tokens"], F.lit(0)), F.when(m["verify_triggered"], F.coalesce(m["verify_score"], F.lit(0)))
    x = answered(spark, d).where("mcq").agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(tokens), F.lit(0)).alias("sum_tokens"), F.count(score).alias("n_verified"), F.coalesce(F.sum(score), F.lit(0)).alias("sum_score"))
    mean = lambda a, n: F.round(F.coalesce(F.try_divide(F.col(a), F.col(n)), F.lit(0.0)), 6)
    return x.select("*", mean("sum_tokens", "n_lines").alias("avg_tokens"), mean("sum_score", "n_verified").alias("avg_score"))


def _top(df, column, k):
    """The k most frequent values; of equal counts, the one seen first."""
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line")).orderBy(F.desc("n_lines"), "first_line").limit(k)


def q_extractor_paths(spark, d):
    return _top(outputs(spark, d).select("line_no", F.col("meta.extractor_path").alias("path")), "path", TOP_PATHS)


def q_recovery_paths(spark, d):
    return _top(outputs(spark, d).select("line_no", F.col("meta.raw_letter_recovery_path").alias("path")), "path", TOP_RECOVERY)


def path_accuracy(x: DataFrame) -> DataFrame:
    y = x.where("mcq").groupBy(F.coalesce(F.nullif("meta.extractor_path", F.lit("")), F.lit("unknown")).alias("path"))
    return y.agg(F.count("*").alias("n_total"), F.count_if("ok").alias("n_correct")).withColumn("accuracy", _rate(F.col("n_correct"), F.col("n_total")))


def q_path_accuracy(spark, d):
    """Judged accuracy per extractor path."""
    return path_accuracy(scored(spark, d))


def q_exact_path_accuracy(spark, d):
    return path_accuracy(exact(spark, d))


def q_token_stats(spark, d):
    m = F.col("meta")
    return outputs(spark, d).groupBy("is_mcq").agg(
        F.count("*").alias("n_lines"),
        F.round(F.coalesce(F.avg(F.coalesce(m["n_tokens"], F.lit(0))), F.lit(0.0)), 6).alias("avg_tokens"),
        F.round(F.coalesce(F.avg(F.when(m["verify_triggered"], F.coalesce(m["verify_score"], F.lit(0)))), F.lit(0.0)), 6).alias("avg_verify_score"),
    )


def q_reasoning_signals(spark, d):
    s = quality.reasoning_signals(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s["steps"].alias("steps"), s["math"].alias("math"), s["surface_only"].alias("surface_only"))


def _diagnosed(spark, d):
    q = questions(spark, d).select("id", is_mcq().alias("mcq"), F.coalesce(F.size("options"), F.lit(0)).alias("n"))
    valid = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1), lambda i: F.char(i + 65))).otherwise(F.array().cast("array<string>"))
    x = outputs(spark, d).select("line_no", "id", "run_stem", F.coalesce("raw", "meta.raw", F.lit("")).alias("raw"), F.coalesce("response", F.lit("")).alias("response"), "meta").join(q, "id")
    x = x.withColumn("valid", valid)
    return x.withColumn("diag", quality.diagnostics(F.col("raw"), F.col("response"), F.col("mcq"), F.col("valid"), F.col("meta.generation_hit_max")))


def q_diagnostics(spark, d):
    keep = ["boxes_raw", "boxes_response", "one_box", "letter_valid", "has_empty", "repeats", "phrases", "confidence", "passes"]
    return _diagnosed(spark, d).select("line_no", *[F.col(f"diag.{k}").alias(k) for k in keep], F.array_join("diag.reasons", ",").alias("reasons"))


def _gate(strict):
    def query(spark: SparkSession, d: str) -> DataFrame:
        x = _diagnosed(spark, d)
        last = outputs(spark, d).groupBy("id", "run_stem").agg(F.max("line_no").alias("line_no"))
        x = x.join(last.select("line_no"), "line_no", "left_semi")
        side = lambda stem, p: x.where(F.col("run_stem") == stem).select("id", *[F.col(c).alias(f"{p}_{c}") for c in ("diag", "response", "raw", "mcq", "valid")])
        both = side("private_full_seed0", "a").join(side("private_lora_seed7", "b"), "id")
        v = quality.deploy_decision(F.col("a_diag"), F.col("b_diag"), F.col("a_response"), F.col("b_response"), F.col("b_raw"), F.col("a_mcq"), F.col("a_valid"), strict)
        return both.select("id", v["winner"].alias("winner"), v["reason"].alias("reason"), v["response"].alias("response"))

    return query


q_deploy_gate = _gate(False)
q_deploy_gate_strict = _gate(True)


def exact_verdict(df: DataFrame, pred: str, gold: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lower(extract_boxed(F.col(pred))) == F.lower(F.get(F.col(gold), F.lit(0))))


def truth_winner(pairs: DataFrame, judge: Callable[[DataFrame, str, str, str], DataFrame] = judged) -> DataFrame:
    """pairs: id, gold (array), a, b. Which of two responses is right by the judge given: four outcomes."""
    x = judge(judge(pairs, "a", "gold", "ok_a"), "b", "gold", "ok_b")
    a, b = F.col("ok_a"), F.col("ok_b")
    return x.select("id", F.when(a & b, "tie_correct").when(a, "base").when(b, "lora").otherwise("tie_wrong").alias("truth_winner"))


def _two_runs(spark, d):
    q = table(spark, d, "public_questions").where("answer is not null").select("id", F.array("answer").alias("gold"))
    o = outputs(spark, d).where("id is not null")
    last = lambda stem, p: o.where(F.col("run_stem") == stem).groupBy("id").agg(F.max_by(F.coalesce("response", F.lit("")), "line_no").alias(p))
    return q.join(last("public_full_seed0", "a"), "id").join(last("public_lora_seed7", "b"), "id")


def q_truth_winner(spark, d):
    """Which of two runs is right, judged against the gold answer."""
    return truth_winner(_two_runs(spark, d))


def q_exact_winner(spark, d):
    """The same with exact texts as the judge."""
    return truth_winner(_two_runs(spark, d), exact_verdict)


def q_recanon_delta(spark, d):
    """Free answers judged as stored and as read again from the raw text: repairs and regressions."""
    x = answered(spark, d).where("not mcq").join(table(spark, d, "public_questions").select("id", "question"), "id")
    raw = F.coalesce(F.nullif("raw", F.lit("")), F.col("meta.raw"))
    y = with_verdict(x.withColumn("raw_text", raw)).select("id", "answer", "raw_text", "question", F.col("ok").alias("ok_before"))
    z = y.withColumn("response", F.when(F.col("raw_text").isNotNull(), free.canonical_free(F.col("raw_text"), F.col("question"))["response"]))
    w = with_verdict(z)
    return w.agg(F.count("*").alias("n_free"), F.count_if(~F.col("ok_before") & F.col("ok")).alias("n_fixes"), F.count_if(F.col("ok_before") & ~F.col("ok") & F.col("response").isNotNull()).alias("n_regressions"))


def q_baseline_accuracy(spark, d):
    """The stored verdicts of the baseline, exact repeats aside."""
    x = table(spark, d, "baseline_results").distinct().groupBy("is_mcq").agg(F.count("*").alias("n_rows"), F.count("correct").alias("n_judged"), F.count_if("correct").alias("n_correct"))
    return x.withColumn("accuracy", _rate(F.col("n_correct"), F.col("n_judged")))


def _fl(c: str) -> str:
    return f"coalesce(meta.{c}, false)"


_RAW = "coalesce(nullif(raw, ''), meta.raw, '')"
_B = duck.boxes("response")
_VALID = duck.labels("options")
_LET = f"{duck.valid_letter('response', 'valid')} <> ''"


def _signal(e: str) -> dict[str, str]:
    filled = f"{duck.strip(f'coalesce({e}, {lit(str())})')} <> ''"
    m, n = duck.count(e, quality.MATH), duck.count(e, "[0-9]")
    return {"steps": f"({filled} AND {duck.count(e, quality.STEP)} >= 2)", "math": f"({filled} AND ({m} >= 2 OR {n} >= 3))", "surface_only": f"({filled} AND coalesce(regexp_matches({e}, {lit(quality.SURFACE)}), false) AND {m} < 2 AND {n} < 3)"}


_HEAD = f"regexp_extract(r, {lit('(?s)^(.*?' + duck.ONE_BOX + ')')}, 1)"


def _report_sql() -> str:
    s = _signal("shown")
    flags = {
        "total": "true", "mcq_total": "mcq", "free_total": "NOT mcq", "malformed_missing_box": "len(b) = 0", "malformed_multiple_box": "len(b) > 1", "malformed_invalid_mcq_letter": "mcq AND len(b) > 0 AND NOT l", "format_ok": "len(b) = 1 AND (NOT mcq OR l)",
        "raw_multi_boxed": f"coalesce(meta.boxed_count_in_raw, len({duck.inners('coalesce(raw, ' + lit('') + ')')})) > 1", "meta_malformed": _fl("malformed_output"),
        "mcq_raw_strict_valid": f"mcq AND len({duck.inners('r')}) = 1 AND len({duck.box_letters('r', 'valid')}) = 1", "mcq_recovered_valid": "mcq AND l", "mcq_empty_boxed": "mcq AND list_contains(b, '')",
        "mcq_invalid_boxed": f"mcq AND len(b) > 0 AND NOT (len({duck.inners('response')}) = 1 AND len({duck.box_letters('response', 'valid')}) = 1)", "mcq_repetition_loop": f"mcq AND (len(list_filter(ra, lambda x: x <> '')) - len(list_distinct(list_filter(ra, lambda x: x <> ''))) >= 2 OR CASE WHEN len(ra) > 0 THEN {duck.count(f'substring(r, length({_HEAD}) + 1)', quality.REPEAT)} ELSE 0 END >= 2)",
        "mcq_raw_boxed_gt1": "mcq AND coalesce(meta.boxed_count_in_raw, 0) > 1", "mcq_verify_low_confidence": f"mcq AND {_fl('verify_triggered')} AND NOT coalesce(contains(meta.verify_reason, 'no_primary_letter'), false)",
        "mcq_generation_hit_max": f"mcq AND {_fl('generation_hit_max')}", "mcq_finalizer_used": f"mcq AND {_fl('finalizer_used')}", "mcq_post_truncated": f"mcq AND {_fl('raw_was_post_truncated')}", "mcq_training_echo": f"mcq AND {_fl('training_echo_detected')}",
        "mcq_letter_recovered": f"mcq AND {_fl('raw_letter_recovered')}", "mcq_guessed": f"mcq AND {_fl('guessed_letter_used')}", "mcq_verify_triggered": f"mcq AND {_fl('verify_triggered')}",
        "mcq_verify_no_primary": f"mcq AND {_fl('verify_triggered')} AND coalesce(contains(meta.verify_reason, 'no_primary_letter'), false)",
    }
    for k in ("steps", "math", "surface_only"):
        flags[f"mcq_{k}"], flags[f"free_{k}"] = f"mcq AND {s[k]}", f"NOT mcq AND {s[k]}"
    cols = ", ".join(f"count(*) FILTER (coalesce({c}, false)) AS {k}" for k, c in flags.items())
    return f"WITH a AS (SELECT *, {_VALID} AS valid, {_RAW} AS r, {_B} AS b FROM {_ANSWERED}), ar AS (SELECT *, {duck.boxes("r")} AS ra FROM a), x AS (SELECT *, {_LET} AS l, CASE WHEN r <> '' THEN r ELSE response END AS shown FROM ar), w AS (SELECT {cols} FROM x) SELECT metric, n FROM w UNPIVOT (n FOR metric IN ({', '.join(flags)}))"


_RATE = "round(coalesce(n_correct / nullif({}, 0) * 100, 0), 6)::DOUBLE"
_TOP = "SELECT path, n_lines, first_line FROM (SELECT {} AS path, count(*) AS n_lines, min(line_no) AS first_line FROM private_outputs GROUP BY 1) WHERE coalesce(path, '') <> '' ORDER BY n_lines DESC, first_line LIMIT {}"
_DOC = _signal("text")


def _diag_sql() -> str:
    head = f"regexp_extract(raw, {lit('(?s)^(.*?' + duck.ONE_BOX + ')')}, 1)"
    return (
        f"(WITH o AS (SELECT o.line_no, o.id, o.run_stem, coalesce(o.raw, o.meta.raw, '') AS raw, coalesce(o.response, '') AS response, coalesce(o.meta.generation_hit_max, false) AS hit, coalesce(len(q.options), 0) > 0 AS mcq, {duck.labels('q.options')} AS valid FROM private_outputs o JOIN {QUESTIONS} q ON o.id = q.id), "
        f"b AS (SELECT *, {duck.boxes('raw')} AS a, {duck.boxes('response')} AS b FROM o), c AS (SELECT *, len(a) AS boxes_raw, len(b) AS boxes_response, len(b) = 1 AND b[1] <> '' AS one_box, "
        f"mcq AND len(b) > 0 AND (({duck.inner_letter('b[-1]', 'valid')}) <> '' OR {duck.valid_letter('raw', 'valid')} <> '') AS letter_valid, list_contains(a, '') OR list_contains(b, '') AS has_empty, "
        f"len(list_filter(a, lambda x: x <> '')) - len(list_distinct(list_filter(a, lambda x: x <> ''))) AS repeats, CASE WHEN len(a) > 0 THEN {duck.count(f'substring(raw, length({head}) + 1)', quality.REPEAT)} ELSE 0 END AS phrases FROM b) "
        "SELECT *, (2 * one_box::INT + 2 * letter_valid::INT + (NOT has_empty)::INT + (repeats = 0)::INT + (phrases = 0)::INT + (NOT hit)::INT + (boxes_response = 1)::INT)::INT AS confidence, "
        "array_to_string(list_filter([CASE WHEN has_empty THEN 'empty_boxed' END, CASE WHEN mcq AND NOT letter_valid THEN 'invalid_mcq_letter' END, CASE WHEN hit AND NOT one_box THEN 'hit_max_no_clean_box' END, CASE WHEN NOT mcq AND boxes_response = 0 THEN 'final_box_malformed' END, CASE WHEN repeats >= 3 THEN 'repeated_boxed_answers' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c)"
    )


def _gate_sql(strict: bool) -> str:
    more = "b.confidence - a.confidence >= 2" if strict else "b.confidence > a.confidence"
    yes, no = ("strict_confidence_delta_ge_2", "strict_confidence_delta_lt_2") if strict else ("higher_lora_confidence", "tie_or_base_higher_confidence")
    pick = "(SELECT * FROM {} WHERE run_stem = '{}' AND line_no IN (SELECT max(line_no) FROM private_outputs GROUP BY id, run_stem))"
    d = _diag_sql()
    return (
        f"WITH a AS {pick.format(d, 'private_full_seed0')}, b AS {pick.format(d, 'private_lora_seed7')}, x AS (SELECT a.id, a.mcq, a.response AS ra, b.response AS rb, "
        f"CASE WHEN b.reasons = '' AND a.reasons <> '' THEN 'base_failed_mandatory' WHEN a.reasons = '' AND b.reasons <> '' THEN 'lora_failed_mandatory' WHEN a.reasons <> '' AND b.reasons <> '' THEN 'both_failed_mandatory' WHEN {more} THEN '{yes}' ELSE '{no}' END AS why, {duck.valid_letter('b.raw', 'a.valid', 1)} AS l FROM a JOIN b ON a.id = b.id), "
        f"y AS (SELECT *, why IN ('base_failed_mandatory', '{yes}') AS wins FROM x) SELECT id, CASE WHEN wins AND NOT (mcq AND l = '') THEN 'lora' ELSE 'base' END AS winner, CASE WHEN wins AND mcq AND l = '' THEN 'lora_no_valid_mcq_letter' ELSE why END AS reason, CASE WHEN NOT wins OR (mcq AND l = '') THEN ra WHEN mcq THEN '\\boxed{{' || l || '}}' ELSE rb END AS response FROM y"
    )


def _winner(stem: str) -> str:
    return f"(SELECT id, coalesce(({duck.boxes(chr(99) + 'oalesce(response, ' + chr(39) * 2 + ')')})[-1], '') AS box FROM private_outputs WHERE run_stem = '{stem}' AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)"


SQL = {
    "q_exact_accuracy": f"WITH x AS (SELECT mcq, count(*) AS n_total, count(*) FILTER (lower(box) = lower(answer)) AS n_correct FROM {_ANSWERED} GROUP BY GROUPING SETS ((mcq), ())) SELECT CASE WHEN mcq IS NULL THEN 'overall' WHEN mcq THEN 'mcq' ELSE 'free' END AS kind, n_total, n_correct, {_RATE.format('n_total')} AS accuracy FROM x",
    "q_metric_report": _report_sql(),
    "q_extractor_paths": _TOP.format("meta.extractor_path", TOP_PATHS),
    "q_recovery_paths": _TOP.format("meta.raw_letter_recovery_path", TOP_RECOVERY),
    "q_exact_path_accuracy": f"SELECT *, {_RATE.format('n_total')} AS accuracy FROM (SELECT coalesce(nullif(meta.extractor_path, ''), 'unknown') AS path, count(*) AS n_total, count(*) FILTER (lower(box) = lower(answer)) AS n_correct FROM {_ANSWERED} WHERE mcq GROUP BY 1)",
    "q_verify_averages": f"SELECT *, round(coalesce(sum_tokens / nullif(n_lines, 0), 0), 6)::DOUBLE AS avg_tokens, round(coalesce(sum_score / nullif(n_verified, 0), 0), 6)::DOUBLE AS avg_score FROM (SELECT count(*) AS n_lines, coalesce(sum(coalesce(meta.n_tokens, 0)), 0)::BIGINT AS sum_tokens, count(*) FILTER (coalesce(meta.verify_triggered, false)) AS n_verified, coalesce(sum(CASE WHEN meta.verify_triggered THEN coalesce(meta.verify_score, 0) END), 0)::BIGINT AS sum_score FROM {_ANSWERED} WHERE mcq)",
    "q_token_stats": "SELECT is_mcq, count(*) AS n_lines, round(coalesce(avg(coalesce(meta.n_tokens, 0)), 0), 6) AS avg_tokens, round(coalesce(avg(CASE WHEN meta.verify_triggered THEN coalesce(meta.verify_score, 0) END), 0), 6) AS avg_verify_score FROM private_outputs GROUP BY is_mcq",
    "q_reasoning_signals": f"SELECT doc_id, {', '.join(f'{c} AS {k}' for k, c in _DOC.items())} FROM documents",
    "q_diagnostics": f"SELECT line_no, boxes_raw::INT AS boxes_raw, boxes_response::INT AS boxes_response, one_box, letter_valid, has_empty, repeats::INT AS repeats, phrases::INT AS phrases, confidence, reasons = '' AS passes, reasons FROM {_diag_sql()}",
    "q_deploy_gate": _gate_sql(False),
    "q_deploy_gate_strict": _gate_sql(True),
    "q_exact_winner": f"SELECT q.id, CASE WHEN lower(a.box) = lower(answer) AND lower(b.box) = lower(answer) THEN 'tie_correct' WHEN lower(a.box) = lower(answer) THEN 'base' WHEN lower(b.box) = lower(answer) THEN 'lora' ELSE 'tie_wrong' END AS truth_winner FROM public_questions q JOIN {_winner('public_full_seed0')} a ON q.id = a.id JOIN {_winner('public_lora_seed7')} b ON q.id = b.id WHERE answer IS NOT NULL",
    "q_baseline_accuracy": f"SELECT *, {_RATE.format('n_judged')} AS accuracy FROM (SELECT is_mcq, count(*) AS n_rows, count(correct) AS n_judged, count(*) FILTER (coalesce(correct, false)) AS n_correct FROM (SELECT DISTINCT * FROM baseline_results) GROUP BY is_mcq)",
}
QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}
