"""Queries that build training examples and account for every refusal, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import quality
from marginalia.functions.text import strip
from marginalia.operators import curate
from marginalia.plans import duck, relational
from marginalia.plans.duck import LAST, QUESTIONS, lit
from marginalia.plans.relational import outputs, questions, records
from marginalia.session import table
from marginalia.sources.adapters import Adapter, adapt


def q_solution_normalise(spark, d):
    return outputs(spark, d).where("raw is not null").select("line_no", quality.normalize_solution(F.col("raw")).alias("solution"))


def q_quality_flags(spark, d):
    """The first flag of each document as a solution to the problem its kind names."""
    return table(spark, d, "documents").select("doc_id", quality.quality_flag(F.col("doc_kind"), F.col("text")).alias("flag"))


def _reasoning(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).select("id", "question")
    x = records(spark, d).select("id", "run_stem", "raw", F.col("meta.boxed").alias("boxed")).join(q, "id")
    return curate.reasoning_examples(x, "question", "raw", "boxed")


def q_reasoning_examples(spark, d):
    return _reasoning(spark, d).select("id", "reason", "prompt", "target")


def q_skip_reasons(spark, d):
    """Refusals per run, and what was accepted."""
    return curate.skip_reasons(_reasoning(spark, d), "run_stem")


def q_top_reasons(spark, d):
    """The five commonest refusals over all runs (a top-k is the feature); names decide between equal counts."""
    return _reasoning(spark, d).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "reason").limit(5)


def _replay_rows(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).select("id", "question", "options", "answer")
    b = table(spark, d, "baseline_results").where("correct is not null").groupBy("id").agg(F.bool_and("correct").alias("correct"))
    return records(spark, d).select("id", "response", "raw", "meta", "is_mcq").join(q, "id", "left").join(b, "id", "left")


def q_base_replay(spark, d):
    return curate.base_replay(_replay_rows(spark, d)).select("id", "kind", "reason", "target")


def q_rejection_replay(spark, d):
    q = questions(spark, d).select("id", "question", "options")
    x = records(spark, d).select("id", "raw", "response", F.col("meta.raw").alias("accepted_raw"), (F.coalesce("meta.n_tokens", F.lit(0)) >= curate.LEAST_TOKENS).alias("filter_passed")).join(q, "id", "left")
    return curate.rejection_replay(x).select("id", "kind", "reason", "target")


def q_adapt_examples(spark, d):
    return curate.adapt_examples(table(spark, d, "public_questions"))


def q_source_columns(spark, d):
    """One question text and one answer from columns that differ by source, by an adapter that names them."""
    q = table(spark, d, "public_questions").select("id", "question", "answer").join(table(spark, d, "baseline_results").groupBy("id").agg(F.min("gold").alias("gold"), F.min("response").alias("target")), "id", "left")
    a = Adapter("mixed", ("question",), (), ("gold", "answer", "target"))
    return adapt(q, a, ("id",)).select("id", F.col("question").alias("problem"), "final_answer")


_SOL = lambda e: duck.strip(f"regexp_replace(regexp_replace(regexp_replace({duck.strip(f'coalesce({e}, {lit(str())})')}, '(?i)</?think>', '', 'g'), '```[\\s\\S]*?```', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_REASON = f"(SELECT r.id, r.run_stem, q.question, {_SOL('r.raw')} AS s, coalesce(r.meta.boxed, '') AS f FROM {LAST} r JOIN {QUESTIONS} q ON r.id = q.id)"
_FLAG = duck.quality_flag("question", "s")
SQL = {
    "q_solution_normalise": f"SELECT line_no, {_SOL('raw')} AS solution FROM private_outputs WHERE raw IS NOT NULL",
    "q_quality_flags": f"SELECT doc_id, {duck.quality_flag('doc_kind', 'text')} AS flag FROM documents",
    "q_source_columns": f"SELECT q.id, nullif({duck.strip('q.question')}, '') AS problem, coalesce(nullif({duck.strip('b.gold')}, ''), nullif({duck.strip('q.answer')}, ''), nullif({duck.strip('b.target')}, '')) AS final_answer FROM public_questions q LEFT JOIN (SELECT id, min(gold) AS gold, min(response) AS target FROM baseline_results GROUP BY id) b ON q.id = b.id",
    "q_skip_reasons": f"WITH x AS (SELECT *, {_FLAG} AS flag FROM {_REASON}) SELECT run_stem, coalesce(flag, 'accepted') AS reason, count(*) AS n_rows FROM x GROUP BY ALL",
    "q_top_reasons": f"WITH x AS (SELECT *, {_FLAG} AS flag FROM {_REASON}) SELECT flag AS reason, count(*) AS n_rows FROM x WHERE flag IS NOT NULL GROUP BY flag ORDER BY n_rows DESC, reason LIMIT 5",
    "q_adapt_examples": (
        f"WITH x AS (SELECT id, question, options, coalesce(len(options), 0) > 0 AS mcq, {duck.strip('answer')} AS t, {duck.labels('options')} AS valid FROM public_questions WHERE answer IS NOT NULL), y AS (SELECT *, {duck.valid_letter('t', 'valid')} AS l, list_filter(range(coalesce(len(options), 0)), lambda i: lower({duck.strip('options[i + 1]')}) = lower(t)) AS hits FROM x), "
        "z AS (SELECT *, CASE WHEN NOT mcq THEN t WHEN t = '' THEN '' WHEN l <> '' THEN l WHEN len(hits) > 0 THEN chr(65 + hits[1]::INT) WHEN list_contains(valid, upper(t)) THEN upper(t) ELSE '' END AS v FROM y) SELECT id, CASE WHEN mcq THEN 'mcq' ELSE 'frq' END AS kind, CASE WHEN v <> '' THEN CASE WHEN mcq THEN {mcq} ELSE {frq} END END AS prompt, CASE WHEN v <> '' THEN '\\boxed{{' || v || '}}' END AS target, '{system}' AS system_prompt, CASE WHEN v <> '' THEN 'final_answer_only' END AS target_kind FROM z"
    ),
}


def _adapt() -> str:
    from marginalia.functions import prompts
    from marginalia.plans import texts

    frq = f"question || {texts._NL2} || CASE WHEN {texts._SLOTS} >= 2 THEN {texts._SLOT_TASK} ELSE {lit(prompts.FREE_TRAIN_TASK)} END"
    return SQL["q_adapt_examples"].replace("{mcq}", texts._mcq(prompts.MCQ_TRAIN_TASK)).replace("{frq}", frq).replace("{system}", curate.SYSTEM_ADAPT).replace("{{", "{").replace("}}", "}")


def _more() -> dict[str, str]:
    from marginalia.functions import prompts
    from marginalia.plans import texts

    gold = lambda o: f"CASE WHEN g = '' THEN '' WHEN gl <> '' THEN gl WHEN len(gh) > 0 THEN chr(65 + gh[1]::INT) WHEN list_contains(gv, upper(g)) THEN upper(g) ELSE '' END"
    clean = f"list_filter(list_transform(coalesce(options, []::VARCHAR[]), lambda x: {duck.strip('x')}), lambda x: x IS NOT NULL AND x <> '')"
    boxed = lambda e: f"coalesce(({duck.boxes(e)})[-1], '')"
    flag = f"WITH x AS (SELECT *, {_FLAG} AS flag FROM {_REASON}), y AS (SELECT *, CASE WHEN flag IS NULL THEN {texts.single_final_box_sql('s', duck.strip('f'))} END AS t FROM x), z AS (SELECT id, question, t, coalesce(flag, CASE WHEN length({duck.strip('t')}) < {curate.LEAST_TARGET} THEN 'target_too_short_after_canonicalize' END) AS reason FROM y)"
    reasoning = f"{flag} SELECT id, reason, CASE WHEN reason IS NULL THEN question || {texts._NL2} || {lit(prompts.REASONING_TASK)} END AS prompt, CASE WHEN reason IS NULL THEN t END AS target FROM z"
    meta = lambda c: f"coalesce(meta.{c}, false)"
    replay = (
        f"WITH a AS (SELECT r.id, r.meta, r.is_mcq, q.question, q.options, q.answer, b.correct, {duck.strip('coalesce(r.response, ' + lit('') + ')')} AS response, {duck.strip('coalesce(nullif(r.raw, ' + lit('') + '), r.meta.raw, ' + lit('') + ')')} AS trace FROM {LAST} r LEFT JOIN {QUESTIONS} q ON r.id = q.id LEFT JOIN (SELECT id, bool_and(correct) AS correct FROM baseline_results WHERE correct IS NOT NULL GROUP BY id) b ON r.id = b.id), "
        f"c AS (SELECT *, {_SOL('trace')} AS canon, {duck.boxes('response')} AS b, {clean} AS o, {duck.strip('coalesce(answer, ' + lit('') + ')')} AS g, {duck.labels('options')} AS gv FROM a), "
        f"d AS (SELECT *, {duck.labels('o')} AS v, coalesce(is_mcq, len(o) > 0) AS mcq, {duck.valid_letter('g', 'gv')} AS gl, list_filter(range(coalesce(len(options), 0)), lambda i: lower({duck.strip('options[i + 1]')}) = lower(g)) AS gh, CASE WHEN canon <> '' THEN canon ELSE response END AS shown FROM c), "
        f"e AS (SELECT *, {gold('')} AS gold, {duck.valid_letter('shown', 'v')} AS found FROM d), f AS (SELECT *, CASE WHEN found <> '' THEN found ELSE gold END AS letter FROM e), "
        f"h AS (SELECT *, CASE WHEN response = '' AND trace = '' THEN 'missing_response' WHEN correct IS NOT NULL AND NOT correct THEN 'marked_incorrect' WHEN correct IS NULL AND len(b) = 0 THEN 'clean_filter_missing_box' WHEN correct IS NULL AND list_contains(b, '') THEN 'clean_filter_empty_boxed' WHEN correct IS NULL AND len(b) > 1 THEN 'clean_filter_multiple_boxed' WHEN correct IS NULL AND {meta('malformed_output')} THEN 'clean_filter_malformed' "
        f"WHEN correct IS NULL AND {meta('generation_hit_max')} THEN 'clean_filter_truncated' WHEN correct IS NULL AND {meta('guessed_letter_used')} THEN 'clean_filter_guessed_letter' WHEN correct IS NULL AND {meta('fallback_used')} THEN 'clean_filter_fallback' WHEN {duck.strip('coalesce(question, ' + lit('') + ')')} = '' THEN 'missing_question_for_replay' "
        "WHEN mcq AND len(o) < 2 THEN 'missing_options_for_replay_mcq' WHEN mcq AND letter = '' THEN 'invalid_replay_mcq_letter' WHEN mcq AND gold <> '' AND letter <> gold THEN 'replay_letter_mismatch_gold' "
        f"WHEN NOT mcq AND {boxed('response')} = '' THEN 'invalid_replay_frq_boxed' END AS reason FROM f) SELECT id, CASE WHEN mcq THEN 'mcq' ELSE 'frq' END AS kind, reason, CASE WHEN reason IS NULL THEN '\\boxed{{' || CASE WHEN mcq THEN letter ELSE {boxed('response')} END || '}}' END AS target FROM h"
    )
    some = ", ".join(f"nullif({duck.strip(c)}, '')" for c in ("r.meta.raw", "r.raw", "r.response"))
    reject = (
        f"WITH a AS (SELECT r.id, coalesce(r.meta.n_tokens, 0) >= {curate.LEAST_TOKENS} AS passed, q.question, q.options, coalesce({some}) AS raw FROM {LAST} r LEFT JOIN {QUESTIONS} q ON r.id = q.id), c AS (SELECT *, {_SOL('raw')} AS s, {clean} AS o FROM a), d AS (SELECT *, {duck.boxes('s')} AS b, {duck.labels('o')} AS v, len(o) > 0 AS mcq, {_FLAG} AS flag FROM c), "
        f"e AS (SELECT *, {duck.valid_letter('s', 'v')} AS l FROM d), f AS (SELECT *, CASE WHEN NOT passed THEN 'filter_not_passed' WHEN {duck.strip('coalesce(question, ' + lit('') + ')')} = '' THEN 'missing_question' WHEN raw IS NULL THEN 'missing_accepted_raw' WHEN s = '' THEN 'empty_after_normalize' WHEN len(b) <> 1 OR b[1] = '' THEN 'invalid_boxed_shape' "
        "WHEN flag IS NOT NULL AND NOT (mcq AND flag = 'multiple_boxed_in_solution') THEN flag WHEN mcq AND len(o) < 2 THEN 'missing_options_for_mcq' WHEN mcq AND l = '' THEN 'missing_or_invalid_mcq_letter' END AS reason FROM e) "
        f"SELECT id, CASE WHEN mcq THEN 'mcq' ELSE 'frq' END AS kind, reason, CASE WHEN reason IS NULL THEN {texts.single_final_box_sql('s', lit(''))} END AS target FROM f"
    )
    return {"q_reasoning_examples": reasoning, "q_base_replay": replay, "q_rejection_replay": reject}


SQL["q_adapt_examples"] = _adapt()
SQL |= _more()
QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}
