"""Queries of scans, joins, sets, samples, batches and checks, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.config import STAGE_KINDS
from marginalia.functions.letters import labels, primary_letter, risk_signal
from marginalia.functions.text import first_filled, normal_newlines, strip
from marginalia.operators import selection
from marginalia.operators.numbering import RANGE_ROWS, hash_key, numbered, with_cells
from marginalia.plans import duck
from marginalia.plans.duck import LAST, QUESTIONS, lit
from marginalia.session import table
from marginalia.sources.adapters import ADAPTERS, kept, options_of

SEED = 17


def questions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "public_questions").select("id", "question", "options", "answer", "split", "source", F.lit("public").alias("origin"))
    b = table(spark, d, "private_questions").select("id", "question", "options", "source", F.lit("private").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True)


def outputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "private_outputs")


def records(spark: SparkSession, d: str) -> DataFrame:
    return selection.last_wins(outputs(spark, d))


def is_mcq(options="options"):
    return F.coalesce(F.size(options), F.lit(0)) > 0


_DUCK_MCQ = "coalesce(len(options), 0) > 0"
_DUCK_HASH = f"('0x' || left(md5('{SEED}:' || id), 15))::BIGINT"


def q_route_counts(spark, d):
    """Multiple-choice and free questions per table, and the mode of each."""
    n = questions(spark, d).groupBy("origin").agg(F.count_if(is_mcq()).alias("n_mcq"), F.count_if(~is_mcq()).alias("n_free"))
    return n.withColumn("mode", F.when((F.col("n_mcq") > 0) & (F.col("n_free") > 0), "mixed").when(F.col("n_mcq") > 0, "mcq-only").otherwise("frq-only"))


def q_done_ids(spark, d):
    return outputs(spark, d).select("id").where("id is not null").distinct()


def q_last_wins(spark, d):
    return records(spark, d).select("id", "line_no", "run_stem", "response")


def q_resume_remaining(spark, d):
    return selection.remaining(questions(spark, d), outputs(spark, d)).select("id", "origin")


def q_missing(spark, d):
    """Questions that no line answers."""
    return selection.remaining(questions(spark, d).select("id", "origin"), outputs(spark, d))


def q_orphan_lines(spark, d):
    """Ids of outputs that no question has, with their lines."""
    return outputs(spark, d).join(questions(spark, d).select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n_lines"))


def q_eval_join(spark, d):
    q = table(spark, d, "public_questions").where("answer is not null").select("id", "answer", is_mcq().alias("mcq"))
    return q.join(records(spark, d).select("id", "line_no", "response"), "id")


def q_reference_lookup(spark, d):
    """One reference per id: the later table wins."""
    rank = F.when(F.col("origin") == "private", 1).otherwise(0)
    return questions(spark, d).groupBy("id").agg(F.max_by("question", rank).alias("question"), F.max_by("origin", rank).alias("origin"))


def q_replay_left_join(spark, d):
    """Lines with what their reference question supplies; a line may lack one."""
    r = records(spark, d).select("id", "line_no", F.lit(None).cast("string").alias("question"), F.lit(None).cast("array<string>").alias("options"))
    x = selection.with_reference(r, questions(spark, d).select("id", "question", "options"))
    return x.select("id", "line_no", first_filled(F.col("question")).alias("question"), F.coalesce(F.size("options"), F.lit(-1)).alias("n_options"), "has_reference")


def q_pair_runs(spark, d):
    """The last line of each id in two runs, side by side."""
    o = outputs(spark, d).where("id is not null")
    run = lambda stem, p: o.where(F.col("run_stem") == stem).groupBy("id").agg(F.max("line_no").alias(f"{p}_line"), F.max_by("response", "line_no").alias(f"{p}_response"))
    return run("private_full_seed0", "base").join(run("private_lora_seed7", "lora"), "id")


def q_batches(spark, d):
    """Batches of 12 over multiple-choice questions, in the order of their ids."""
    return selection.batched(questions(spark, d).where(is_mcq()).select("id"), "id", 12)


def q_verify_budget(spark, d):
    q = questions(spark, d).where(is_mcq()).select("id", "options")
    r = records(spark, d).select("id", F.coalesce("raw", F.lit("")).alias("raw"))
    x = selection.batched(q.join(r, "id"), "id", 12).withColumn("valid", labels(F.col("options")))
    x = x.withColumn("letter", primary_letter(F.col("raw"), F.col("raw"), F.col("valid"))["letter"]).withColumn("score", risk_signal(F.col("raw"), F.col("valid"))["score"])
    return selection.verify_budget(x, "id", "letter", "score").select("id", "batch_id", "letter", "score", "forced")


def q_sorted_check(spark, d, rows=RANGE_ROWS):
    """Whether the ids of each run stand in order, by its lines: within ranges of lines, and between the last and the first id of neighbouring ranges."""
    x = with_cells(outputs(spark, d).select("run_stem", "line_no", "id"), "line_no", rows)
    within = Window.partitionBy("run_stem", "__range").orderBy("line_no")
    behind = lambda back, own: F.count_if(F.coalesce(back, own) > own)
    cells = x.withColumn("back", F.lag("id").over(within)).groupBy("run_stem", "__range").agg(behind(F.col("back"), F.col("id")).alias("n"), F.min_by("id", "line_no").alias("first"), F.max_by("id", "line_no").alias("last"))
    edge = F.lag("last").over(Window.partitionBy("run_stem").orderBy("__range"))
    y = cells.withColumn("back", edge).groupBy("run_stem").agg((F.sum("n") + behind(F.col("back"), F.col("first"))).alias("n_out_of_order"))
    return y.select("run_stem", "n_out_of_order", (F.col("n_out_of_order") == 0).alias("is_sorted"))


def q_type_cap(spark, d):
    return selection.capped_by_kind(questions(spark, d).select("id", is_mcq().alias("mcq")), "mcq", {True: 40, False: 80}, SEED)


def q_sample_cap(spark, d):
    """A sample of 100 public questions by hash order: a top-k."""
    return table(spark, d, "public_questions").select("id", hash_key(SEED, "id").alias("h")).orderBy("h", "id").limit(100).select("id")


def q_holdout_split(spark, d):
    return selection.with_holdout(table(spark, d, "public_questions").where("answer is not null").select("id"), 0.3, SEED)


def q_submission_checks(spark, d):
    """One row per run: what a submission of its last lines would be refused for."""
    o = outputs(spark, d).where("id is not null")
    q = table(spark, d, "private_questions").select("id")
    n_q = q.agg(F.count("*").alias("n_questions"))
    known = o.join(q, "id", "left_semi").groupBy("run_stem").agg(F.count_distinct("id").alias("n_known"))
    per = o.groupBy("run_stem").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("id").alias("n_ids"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
        F.count_if(strip(F.coalesce("response", F.lit(""))) == "").alias("n_empty"),
        F.count_if(~F.coalesce(F.col("response").contains("\\boxed"), F.lit(False))).alias("n_unboxed"),
    )
    x = per.join(known, "run_stem", "left").join(F.broadcast(n_q))  # one row
    return x.select("run_stem", "n_rows", "n_ids", (F.col("n_rows") - F.col("n_ids")).alias("n_duplicate"), (F.col("n_questions") - F.coalesce("n_known", F.lit(0))).alias("n_missing"), "min_id", "max_id", "n_empty", "n_unboxed")


def q_weighted_mix(spark, d):
    """Questions mixed by source: two sources gain, one shrinks."""
    q = table(spark, d, "public_questions").select("id", F.coalesce("source", F.lit("(none)")).alias("source"))
    w = F.when(F.col("source") == "north-exams", 1.75).when(F.col("source") == "riddle-corner", 3.0).when(F.col("source") == "quarry-sheets", 0.4).otherwise(1.0)
    return selection.weighted(q, "source", w, SEED, "id").select("id", "source", "copy")


def q_union_sources(spark, d):
    return questions(spark, d).groupBy("origin", F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("n_loaded"), F.count("answer").alias("n_accepted"), (F.count("*") - F.count("answer")).alias("n_skipped"))


def q_id_diff(spark, d):
    """Ids on one side only: questions without a line, lines without a question."""
    q, o = questions(spark, d).select("id").distinct(), outputs(spark, d).select("id").where("id is not null").distinct()
    return q.join(o, "id", "left_anti").select("id", F.lit("question").alias("side")).unionByName(o.join(q, "id", "left_anti").select("id", F.lit("line").alias("side")))


_OR = r"(^|[^a-zA-Z])or([^a-zA-Z]|$)"


def q_set_normalise(spark, d):
    """Answers as the different parts of a set, in order (split at commas and at the word "or")."""
    parts = F.split(F.regexp_replace("answer", _OR, "$1,$2"), ",", -1)
    return table(spark, d, "public_questions").where("answer is not null").select("id", F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")), " | ").alias("parts"))


def q_id_stats(spark, d):
    return outputs(spark, d).groupBy("run_stem").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("n_lines"), F.count_distinct("id").alias("n_ids"), (F.count("id") - F.count_distinct("id")).alias("n_repeats"), F.count_if(F.col("id").isNull()).alias("n_null"))


def q_prefix_limit(spark, d):
    """The first 500 public questions in their order (a prefix limit is the feature)."""
    return table(spark, d, "public_questions").select("id", "question").orderBy("id").limit(500)


def q_restore_order(spark, d):
    """Records in the order of their questions, each with its place."""
    q = numbered(questions(spark, d).select("id"), "id", name="pos")
    return q.join(records(spark, d).select("id", "line_no"), "id").select("id", "pos", "line_no")


def q_supervised(spark, d):
    return table(spark, d, "public_questions").groupBy("split").agg(F.count("*").alias("n_rows"), F.count("answer").alias("n_supervised"), (F.count("answer") > 0).alias("has_answers"))


TASKS = replace(ADAPTERS["ultrainteract"], keep={"source": ("openbench-a", "openbench-b")})


def q_task_filter(spark, d):
    """Rows that an adapter keeps by a column's value (trimmed first; here of two named sources), counted before and after."""
    q = table(spark, d, "public_questions").select("id", "split", "source")
    some = kept(q, TASKS).groupBy("split").agg(F.count("*").alias("n_kept"))
    per = q.groupBy("split").agg(F.count("*").alias("n_loaded"))
    return per.join(some, per["split"].eqNullSafe(some["split"]), "left").select(per["split"], "n_loaded", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def q_stage_filter(spark, d):
    """What each stage of training keeps, by the kinds of its settings."""
    q = table(spark, d, "public_questions").where("answer is not null").select(F.when(is_mcq(), "mcq").otherwise("frq").alias("kind"))
    stages = F.array(*[F.when(F.col("kind").isin(*kinds), F.lit(s)) for s, kinds in STAGE_KINDS.items()])
    return q.select(F.explode(F.filter(stages, lambda s: s.isNotNull())).alias("stage"), "kind").groupBy("stage", "kind").agg(F.count("*").alias("n_rows"))


def q_option_checks(spark, d):
    """Options cleaned of blanks: how many, and whether they repeat (case aside)."""
    clean = F.filter(F.transform("options", lambda o: strip(o)), lambda o: o != "")
    return questions(spark, d).where(is_mcq()).select("id", F.size(clean).cast("long").alias("n_options"), (F.size(clean) >= 2).alias("enough"), (F.size(F.array_distinct(F.transform(clean, lambda o: F.lower(o)))) < F.size(clean)).alias("repeats"))


def q_coalesce_fields(spark, d):
    """The first filled of several fields, in order: response, cleaned response, box, raw text."""
    m = F.col("meta")
    return outputs(spark, d).select("line_no", first_filled(F.col("response"), m["cleaned_response"], m["boxed"], F.col("raw"), m["raw"]).alias("text"))


def q_option_columns(spark, d):
    """Options from one column per letter where there are two at least; else the array."""
    q = questions(spark, d).where(is_mcq()).select("id", F.col("options").alias("choices"), *[F.get("options", F.lit(i)).alias(chr(65 + i)) for i in range(10)])
    return q.select("id", F.array_join(options_of(q, ADAPTERS["math_mc"]), "|").alias("options_text"))


def q_newline_normalise(spark, d):
    t = normal_newlines(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.regexp_count(t, F.lit("\n")).cast("long").alias("n_newlines"), F.md5(t).alias("digest"))


def q_multiset_match(spark, d):
    """Whether answer and response hold the same values in any order, repeats counted."""
    parts = lambda c: F.array_sort(F.filter(F.transform(F.split(c, "[,;|]", -1), lambda x: strip(x)), lambda x: x != ""))
    b = table(spark, d, "baseline_results").where("gold is not null and response is not null").distinct()
    from marginalia.functions.boxed import extract_boxed

    return b.select("id", "gold", "response", (parts(F.col("gold")) == parts(extract_boxed(F.col("response")))).alias("same"))


def q_zip_options(spark, d):
    """Labels and options by position."""
    z = F.explode(F.zip_with(labels(F.col("options")), F.col("options"), lambda l, o: F.struct(l.alias("label"), o.alias("option"))))
    return questions(spark, d).where(is_mcq()).select("id", z.alias("z")).select("id", "z.label", "z.option")


def q_shuffled(spark, d):
    """A seeded order of the public questions."""
    return numbered(table(spark, d, "public_questions").select("id", hash_key(SEED, "id").alias("h")), "h", ["id"], name="pos").select("id", "pos")


_LINES = "private_outputs"
SQL = {
    "q_route_counts": f"SELECT origin, n_mcq, n_free, CASE WHEN n_mcq > 0 AND n_free > 0 THEN 'mixed' WHEN n_mcq > 0 THEN 'mcq-only' ELSE 'frq-only' END AS mode FROM (SELECT origin, count(*) FILTER ({_DUCK_MCQ}) AS n_mcq, count(*) FILTER (NOT {_DUCK_MCQ}) AS n_free FROM {QUESTIONS} GROUP BY origin)",
    "q_done_ids": "SELECT DISTINCT id FROM private_outputs WHERE id IS NOT NULL",
    "q_last_wins": f"SELECT id, line_no, run_stem, response FROM {LAST}",
    "q_resume_remaining": f"SELECT id, origin FROM {QUESTIONS} WHERE id NOT IN (SELECT id FROM private_outputs WHERE id IS NOT NULL)",
    "q_missing": f"SELECT id, origin FROM {QUESTIONS} WHERE id NOT IN (SELECT id FROM private_outputs WHERE id IS NOT NULL)",
    "q_orphan_lines": f"SELECT id, count(*) AS n_lines FROM private_outputs WHERE id NOT IN (SELECT id FROM {QUESTIONS}) OR id IS NULL GROUP BY id",
    "q_eval_join": f"SELECT q.id, q.answer, {_DUCK_MCQ} AS mcq, r.line_no, r.response FROM public_questions q JOIN {LAST} r ON q.id = r.id WHERE q.answer IS NOT NULL",
    "q_reference_lookup": f"SELECT id, question, origin FROM {QUESTIONS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY origin = 'private' DESC) = 1",
    "q_replay_left_join": f"SELECT r.id, r.line_no, nullif({duck.strip('q.question')}, '') AS question, coalesce(len(q.options), -1)::INT AS n_options, q.id IS NOT NULL AS has_reference FROM {LAST} r LEFT JOIN {QUESTIONS} q ON q.id = r.id",
    "q_pair_runs": "WITH r AS (SELECT id, run_stem, line_no, response FROM private_outputs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, run_stem ORDER BY line_no DESC) = 1) SELECT a.id, a.line_no AS base_line, a.response AS base_response, b.line_no AS lora_line, b.response AS lora_response FROM r a JOIN r b ON a.id = b.id WHERE a.run_stem = 'private_full_seed0' AND b.run_stem = 'private_lora_seed7'",
    "q_batches": f"SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 12)::BIGINT AS batch_id FROM {QUESTIONS} WHERE {_DUCK_MCQ}",
    "q_sorted_check": "SELECT run_stem, count(*) FILTER (NOT ok) AS n_out_of_order, bool_and(coalesce(ok, true)) AS is_sorted FROM (SELECT run_stem, coalesce(lag(id) OVER (PARTITION BY run_stem ORDER BY line_no), id) <= id AS ok FROM private_outputs) GROUP BY run_stem",
    "q_type_cap": f"SELECT id, {_DUCK_MCQ} AS mcq FROM {QUESTIONS} QUALIFY row_number() OVER (PARTITION BY {_DUCK_MCQ} ORDER BY {_DUCK_HASH}, id) <= CASE WHEN {_DUCK_MCQ} THEN 40 ELSE 80 END",
    "q_sample_cap": f"SELECT id FROM public_questions ORDER BY {_DUCK_HASH}, id LIMIT 100",
    "q_holdout_split": f"SELECT id, row_number() OVER (ORDER BY {_DUCK_HASH}, id) <= least(greatest(1, round_even(count(*) OVER () * 0.3, 0)), count(*) OVER () - 1) AS held_out FROM public_questions WHERE answer IS NOT NULL",
    "q_submission_checks": f"SELECT run_stem, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) - count(DISTINCT id) AS n_duplicate, (SELECT count(*) FROM private_questions) - count(DISTINCT id) FILTER (id IN (SELECT id FROM private_questions)) AS n_missing, min(id) AS min_id, max(id) AS max_id, count(*) FILTER ({duck.strip(chr(99) + 'oalesce(response, ' + chr(39) * 2 + ')')} = '') AS n_empty, count(*) FILTER (NOT coalesce(contains(response, '\\boxed'), false)) AS n_unboxed FROM private_outputs WHERE id IS NOT NULL GROUP BY run_stem",
    "q_weighted_mix": f"WITH w AS (SELECT id, coalesce(source, '(none)') AS source, CASE source WHEN 'north-exams' THEN 1.75 WHEN 'riddle-corner' THEN 3.0 WHEN 'quarry-sheets' THEN 0.4 ELSE 1.0 END::DOUBLE AS w FROM public_questions), n AS (SELECT *, floor(w) + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {_DUCK_HASH}, id) <= round_even(count(*) OVER (PARTITION BY source) * (w - floor(w)), 0) THEN 1 ELSE 0 END AS k FROM w) SELECT id, source, c::INT AS copy FROM (SELECT id, source, unnest(range(1, k::BIGINT + 1)) AS c FROM n)",
    "q_union_sources": f"SELECT origin, coalesce(source, '(none)') AS source, count(*) AS n_loaded, count(answer) AS n_accepted, count(*) - count(answer) AS n_skipped FROM {QUESTIONS} GROUP BY ALL",
    "q_id_diff": f"WITH q AS (SELECT DISTINCT id FROM {QUESTIONS}), o AS (SELECT DISTINCT id FROM private_outputs WHERE id IS NOT NULL) SELECT id, 'question' AS side FROM q WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, 'line' FROM o WHERE id NOT IN (SELECT id FROM q)",
    "q_set_normalise": f"SELECT id, array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ' | ') AS parts FROM (SELECT id, list_filter(list_transform(string_split(regexp_replace(answer, {lit(_OR)}, '\\1,\\2', 'g'), ','), lambda x: {duck.strip('x')}), lambda x: x <> '') AS parts FROM public_questions WHERE answer IS NOT NULL)",
    "q_id_stats": "SELECT run_stem, min(id) AS min_id, max(id) AS max_id, count(*) AS n_lines, count(DISTINCT id) AS n_ids, count(id) - count(DISTINCT id) AS n_repeats, count(*) FILTER (id IS NULL) AS n_null FROM private_outputs GROUP BY run_stem",
    "q_prefix_limit": "SELECT id, question FROM public_questions ORDER BY id LIMIT 500",
    "q_restore_order": f"SELECT q.id, q.pos, r.line_no FROM (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM {QUESTIONS}) q JOIN {LAST} r ON q.id = r.id",
    "q_supervised": "SELECT split, count(*) AS n_rows, count(answer) AS n_supervised, count(answer) > 0 AS has_answers FROM public_questions GROUP BY split",
    "q_task_filter": f"SELECT split, count(*) AS n_loaded, count(*) FILTER ({duck.strip(chr(99) + 'oalesce(source, ' + chr(39) * 2 + ')')} IN ('openbench-a', 'openbench-b')) AS n_kept FROM public_questions GROUP BY split",
    "q_stage_filter": f"WITH q AS (SELECT CASE WHEN {_DUCK_MCQ} THEN 'mcq' ELSE 'frq' END AS kind FROM public_questions WHERE answer IS NOT NULL), s AS (SELECT * FROM (VALUES {', '.join(f'({lit(k)}, {lit(v)})' for k, vs in STAGE_KINDS.items() for v in vs)}) t(stage, kind)) SELECT stage, kind, count(*) AS n_rows FROM q JOIN s USING (kind) GROUP BY ALL",
    "q_option_checks": f"WITH o AS (SELECT id, list_filter(list_transform(options, lambda x: {duck.strip('x')}), lambda x: x <> '') AS c FROM {QUESTIONS} WHERE {_DUCK_MCQ}) SELECT id, len(c) AS n_options, len(c) >= 2 AS enough, len(list_distinct(list_transform(c, lambda x: lower(x)))) < len(c) AS repeats FROM o",
    "q_coalesce_fields": "SELECT line_no, coalesce(" + ", ".join(f"nullif({duck.strip(c)}, '')" for c in ("response", "meta.cleaned_response", "meta.boxed", "raw", "meta.raw")) + ") AS text FROM private_outputs",
    "q_option_columns": f"WITH o AS (SELECT id, list_filter(list_transform(options, lambda x: {duck.strip('x')}), lambda x: x IS NOT NULL AND x <> '') AS a, list_filter(list_transform(options[1:10], lambda x: {duck.strip('x')}), lambda x: x IS NOT NULL AND x <> '') AS c FROM {QUESTIONS} WHERE {_DUCK_MCQ}) SELECT id, array_to_string(CASE WHEN len(c) >= 2 THEN c WHEN len(a) > 0 THEN a END, '|') AS options_text FROM o",
    "q_newline_normalise": "WITH t AS (SELECT doc_id, regexp_replace(text, '\r\n?', '\n', 'g') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(t) AS n_chars, length(t) - length(replace(t, '\n', '')) AS n_newlines, md5(t) AS digest FROM t",
    "q_multiset_match": f"WITH b AS (SELECT DISTINCT * FROM baseline_results WHERE gold IS NOT NULL AND response IS NOT NULL), p AS (SELECT *, coalesce(({duck.boxes('response')})[-1], '') AS v FROM b) SELECT id, gold, response, list_sort(list_filter(list_transform(regexp_split_to_array(gold, '[,;|]'), lambda x: {duck.strip('x')}), lambda x: x <> '')) = list_sort(list_filter(list_transform(regexp_split_to_array(v, '[,;|]'), lambda x: {duck.strip('x')}), lambda x: x <> '')) AS same FROM p",
    "q_zip_options": f"SELECT id, chr(64 + i::INT) AS label, options[i] AS option FROM (SELECT id, options, unnest(range(1, len(options) + 1)) AS i FROM {QUESTIONS} WHERE {_DUCK_MCQ})",
    "q_shuffled": f"SELECT id, row_number() OVER (ORDER BY {_DUCK_HASH}, id) AS pos FROM public_questions",
}


def _budget() -> str:
    """Needs the SQL of texts, which needs this module's helpers: built when asked for."""
    from marginalia.plans import texts

    risk = texts.SQL["q_risk_score"]
    first = texts.primary_sql("coalesce(raw, '')")
    return (
        f"WITH m AS (SELECT q.id, r.line_no FROM {QUESTIONS} q JOIN {LAST} r ON q.id = r.id WHERE len(q.options) > 0), p AS (SELECT m.id, p.letter, coalesce(s.score, 4) AS score, ((row_number() OVER (ORDER BY m.id) - 1) // 12)::BIGINT AS batch_id FROM m JOIN {first} p ON m.line_no = p.line_no LEFT JOIN ({risk}) s ON m.line_no = s.line_no), "
        "b AS (SELECT *, letter <> '' AND score >= 2 AS risky, ceil(count(*) OVER (PARTITION BY batch_id) * 0.25) AS budget FROM p) SELECT id, batch_id, letter, score, letter = '' OR (risky AND sum(risky::INT) OVER (PARTITION BY batch_id ORDER BY id ROWS UNBOUNDED PRECEDING) <= budget) AS forced FROM b"
    )


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}
