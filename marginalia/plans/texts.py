"""Queries of boxes, letters, thoughts, free answers and prompts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import boxed, free, letters, prompts, think
from marginalia.functions.text import last_of, strip
from marginalia.operators import guess
from marginalia.plans import duck
from marginalia.plans.duck import LAST, QUESTIONS, lit
from marginalia.plans.relational import is_mcq, outputs, questions, records
from marginalia.session import table

SEP = "¦"
R, P = "private_outputs WHERE raw IS NOT NULL", "private_outputs WHERE response IS NOT NULL"


def raws(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d).where("raw is not null")


def responses(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d).where("response is not null")


def mcq_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of multiple-choice questions with their labels. The labels depend on the number of options only, so no text of a question is shuffled."""
    q = questions(spark, d).where(is_mcq()).select("id", F.size("options").alias("n_options"))
    valid = F.transform(F.sequence(F.lit(0), F.col("n_options") - 1), lambda i: F.char(i + 65))
    return outputs(spark, d).select("line_no", "id", "raw", "response", "meta").join(q, "id").withColumn("valid", valid)


_MCQ_LINES = f"(SELECT o.line_no, o.id, o.raw, o.response, o.meta, q.options, {duck.labels('q.options')} AS valid FROM private_outputs o JOIN {QUESTIONS} q ON o.id = q.id WHERE len(q.options) > 0)"


def q_all_boxed(spark, d):
    b = boxed.extract_all_boxed(F.col("raw"))
    return raws(spark, d).select("line_no", F.size(b).cast("long").alias("n_boxes"), F.array_join(b, SEP).alias("boxes"))


def q_last_boxed(spark, d):
    return responses(spark, d).select("line_no", boxed.extract_boxed(F.col("response")).alias("box"), boxed.has_complete_boxed(F.col("response")).alias("has_box"))


def q_boxed_spans(spark, d):
    """Offsets need a scan of each text: an Arrow function."""
    return raws(spark, d).select("line_no", F.explode(boxed.boxed_spans(F.col("raw"))).alias("s")).select("line_no", "s.start", "s.end", "s.inner")


def q_last_group(spark, d):
    """The boxes of the last group that only punctuation separates, empty ones dropped."""
    return raws(spark, d).select("line_no", F.array_join(boxed.last_group(F.col("raw")), SEP).alias("boxes"))


def q_last_boxed_string(spark, d):
    return raws(spark, d).select("line_no", boxed.last_boxed_string(F.col("raw")).alias("box"))


def q_baseline_letter(spark, d):
    """Simple readings: a box of one letter or the last letter that stands alone; a marked final letter, a box, the first that stands alone."""
    r = F.col("response")
    flat = strip(last_of(F.regexp_extract_all(r, F.lit(r"\\boxed\{([^{}]+)\}"), F.lit(1))))
    return responses(spark, d).select("line_no", letters.simple_letter(r).alias("letter"), letters.marked_letter(r).alias("marked_letter"), F.coalesce(flat, F.lit("")).alias("flat_box"))


def q_visible_answer(spark, d):
    return raws(spark, d).select("line_no", think.visible_answer(F.col("raw")).alias("visible"))


def q_strip_thinking_v1(spark, d):
    return raws(spark, d).select("line_no", think.strip_thinking_first(F.col("raw")).alias("text"))


def q_strip_thinking_v2(spark, d):
    return raws(spark, d).select("line_no", think.strip_thinking_last(F.col("raw")).alias("text"))


def q_clean_tokens(spark, d):
    return raws(spark, d).select("line_no", think.clean_special_tokens(F.col("raw")).alias("text"))


def q_clean_visible(spark, d):
    return raws(spark, d).select("line_no", think.clean_visible(F.col("raw")).alias("text"))


def _letter(f, c="raw"):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return mcq_lines(spark, d).where(f"{c} is not null").select("line_no", f(F.col(c), F.col("valid")).alias("letter"))

    return query


q_valid_letter = _letter(letters.extract_valid_letter)
q_first_letter = _letter(letters.extract_first_valid_letter)
q_tail_letter = _letter(letters.tail_letter)
q_last_valid_letter = _letter(letters.last_valid_letter)
q_option_phrase = _letter(letters.option_phrase_letter)


def q_primary_pass(spark, d):
    x = mcq_lines(spark, d).withColumn("raw", F.coalesce("raw", F.lit(""))).withColumn("before", F.coalesce(F.col("meta.raw"), F.col("raw")))
    p = letters.primary_letter(F.col("raw"), F.col("before"), F.col("valid"))
    return x.select("line_no", p["letter"].alias("letter"), p["path"].alias("path"))


def _guess_lines(spark, d):
    texts = ((F.col("raw"), "primary"), (F.col("meta.raw"), "before"), (F.col("response"), "final"))
    return mcq_lines(spark, d).select("line_no", "id", "valid", *[F.coalesce(c, F.lit("")).alias(n) for c, n in texts])


def q_signal_guess(spark, d):
    """The fallback cascade over the response as second text and raw as first one, without the text of options."""
    g = guess.best_guess(F.col("primary"), F.col("before"), F.col("final"), F.col("valid"))
    return _guess_lines(spark, d).select("line_no", g["letter"].alias("letter"), g["path"].alias("path"), g["tier"].alias("tier"))


def q_best_guess(spark, d):
    """The whole fallback cascade: lines without a signal are matched with the text of an option."""
    lines = _guess_lines(spark, d).join(questions(spark, d).select("id", "options"), "id")
    return guess.guessed(lines, "primary", "before", "final", "valid", "options").select("line_no", "guess.letter", "guess.path", "guess.tier")


def q_risk_score(spark, d):
    s = letters.risk_signal(F.col("raw"), F.col("valid"))
    return mcq_lines(spark, d).where("raw is not null").select("line_no", s["score"].alias("score"), F.array_join(s["reasons"], ",").alias("reasons"))


def q_training_echo(spark, d):
    return raws(spark, d).select("line_no", letters.has_training_echo(F.col("raw")).alias("echo"))


def q_valid_box_form(spark, d):
    """Whether the raw text holds exactly one box and it is a valid letter."""
    b = boxed.extract_boxed_inner(F.col("raw"))
    ok = (F.size(b) == 1) & (F.coalesce(letters.letter_of_inner(F.try_element_at(b, F.lit(1)), F.col("valid")), F.lit("")) != "")
    return mcq_lines(spark, d).where("raw is not null").select("line_no", ok.alias("strict_valid"))


def q_last_latex(spark, d):
    return raws(spark, d).select("line_no", free.last_latex_block(F.col("raw")).alias("block"))


def q_answer_phrase(spark, d):
    return responses(spark, d).select("line_no", free.last_answer_phrase(F.col("response")).alias("phrase"))


def q_ensure_boxed(spark, d):
    return responses(spark, d).select("line_no", free.ensure_boxed(F.col("response")).alias("text"))


def q_ans_slots(spark, d):
    return questions(spark, d).select("id", free.ans_slots(F.col("question")).cast("long").alias("n_slots"))


def q_comma_values(spark, d):
    return table(spark, d, "public_questions").where("answer is not null").select("id", F.array_join(free.comma_values(F.col("answer")), SEP).alias("parts"))


def frq_lines(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).where(~is_mcq()).select("id", "question")
    return outputs(spark, d).select("line_no", "id", "raw", "response").join(q, "id")


def q_multi_values(spark, d):
    v = free.multi_values(think.visible_answer(F.col("raw")), free.ans_slots(F.col("question")))
    return frq_lines(spark, d).where("raw is not null").select("line_no", F.array_join(v, SEP).alias("parts"), F.size(v).cast("long").alias("n_values"))


def q_free_canonical(spark, d):
    c = free.canonical_free(F.col("raw"), F.col("question"))
    return frq_lines(spark, d).where("raw is not null").select("line_no", c["response"].alias("response"), c["path"].alias("path"), F.array_join(c["values"], SEP).alias("parts"))


def q_mcq_canonical(spark, d):
    l = letters.last_valid_letter(F.col("raw"), F.col("valid"))
    return mcq_lines(spark, d).where("raw is not null").select("line_no", free.canonical_mcq(F.col("raw"), l).alias("text"), free.box(l).alias("short"))


def q_box_cuts(spark, d):
    return raws(spark, d).select("line_no", free.rstrip(free.after_first_box_cut(F.col("raw"))).alias("first_cut"), free.rstrip(free.after_last_box_cut(F.col("raw"))).alias("last_cut"))


def q_smart_truncate(spark, d):
    """Cut behind the box that is most likely final; tokens counted as words of letters, digits or single signs."""
    return mcq_lines(spark, d).where("raw is not null").select("line_no", guess.smart_cut(F.col("raw"), F.col("valid")).alias("text"))


def q_normalize_answer(spark, d):
    return table(spark, d, "public_questions").where("answer is not null").select("id", free.normalize_answer(F.col("answer")).alias("answer"))


def q_single_final_box(spark, d):
    return responses(spark, d).select("line_no", free.single_final_box(F.col("response"), F.col("meta.boxed")).alias("text"))


def q_submission_format(spark, d):
    raw = F.coalesce(F.nullif(F.col("raw"), F.lit("")), F.nullif(F.col("meta.raw"), F.lit("")), F.lit(""))
    return outputs(spark, d).select("line_no", free.submission_format(raw, F.col("response")).alias("text"))


def q_prompts(spark, d):
    q, o = F.col("question"), F.col("options")
    free_, mcq = questions(spark, d).where(~is_mcq()), questions(spark, d).where(is_mcq())
    a = mcq.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("prompt")) for k, p in (("mcq", prompts.mcq_prompt(q, o)), ("mcq_strict", prompts.strict_mcq_prompt(q, o)), ("mcq_train", prompts.mcq_prompt(q, o, prompts.MCQ_TRAIN_TASK)))])).alias("x"))
    b = free_.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("prompt")) for k, p in (("free", prompts.free_prompt(q)), ("free_train", prompts.free_train_prompt(q)), ("reasoning", prompts.reasoning_prompt(q)))])).alias("x"))
    return a.unionByName(b).select("id", "x.kind", "x.prompt")


def q_chat_template(spark, d):
    system = F.lit("You solve competition mathematics.")
    return questions(spark, d).select("id", prompts.chat(system, prompts.free_prompt(F.col("question"))).alias("text"), prompts.chat(system, F.col("question"), False).alias("quiet_text"))


def q_early_stop(spark, d):
    """Whether generation could have stopped: a marked or boxed letter, or a closed box behind the first thought."""
    after = F.regexp_replace(F.col("raw"), "(?s)^.*?</think>", "")
    letter = F.col("raw").rlike(r"(?i)FINAL\s*:\s*[A-J]\b|\\boxed\{\s*[A-J]\s*\}")
    return raws(spark, d).select("line_no", letter.alias("letter_stop"), (F.col("raw").contains("</think>") & boxed.has_complete_boxed(after)).alias("box_stop"))


def _rx(e: str, p: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({e}, {lit(p)}, {lit(to)}, '{flags}')"


def simple_letter_sql(e: str) -> str:
    """The box of one letter, else the last letter that stands alone: the greedy start leaves the last place."""
    last = rf"(?s)^.*(?:^|[^{letters.WORD}])([A-Z])(?:[^{letters.WORD}]|$)"
    return f"coalesce(nullif(upper(regexp_extract({e}, {lit(BOX_OF_ONE)}, 1)), ''), regexp_extract(upper({e}), {lit(last)}, 1), '')"


def marked_letter_sql(e: str) -> str:
    final = rf"(?i)FINAL[{letters.SPACE}]*:[{letters.SPACE}]*([A-J])(?:[^{letters.WORD}]|$)"
    box = rf"(?i)\\boxed\{{[{letters.SPACE}]*([A-J])[{letters.SPACE}]*\}}"
    first = rf"(?:^|[^{letters.WORD}])([A-J])(?:[^{letters.WORD}]|$)"
    found = ", ".join(f"nullif(upper(regexp_extract({e}, {lit(p)}, 1)), '')" for p in (final, box))
    return f"coalesce({found}, regexp_extract(upper({e}), {lit(first)}, 1))"


BOX_OF_ONE = r"\\boxed\{([A-Za-z])\}"
_V = "valid"
_POINTS = ".,:; \\t"
_LATEX = [f"{duck.strip(f'(regexp_extract_all(T, {lit(p)}, 1))[-1]')}" for p in free.LATEX_BLOCKS]


def _latex(e: str) -> str:
    return f"coalesce({', '.join(x.replace('T', e, 1) if False else x.replace('(T,', f'({e},') for x in _LATEX)}, '')"


def _phrase(e: str) -> str:
    vals = [f"nullif({duck.strip(f'(regexp_extract_all({e}, {lit(p)}, 1))[-1]', _POINTS)}, '')" for p in free.ANSWER_PHRASES]
    return f"coalesce({', '.join(vals)}, (regexp_extract_all({e}, {lit(free.NUMBER)}, 1))[-1], '')"


def _ensure(e: str) -> str:
    after = duck.strip(f"(string_split({e}, '</think>'))[-1]")
    shown = f"CASE WHEN contains({e}, '</think>') AND {after} <> '' THEN {after} ELSE {e} END"
    return f"CASE WHEN len({duck.inners(e)}) > 0 THEN {e} ELSE {duck.rstrip(e)} || chr(10) || chr(10) || '\\boxed{{' || (CASE WHEN {_latex(f'({shown})')} <> '' THEN {_latex(f'({shown})')} ELSE {_phrase(f'({shown})')} END) || '}}' END"


def _labels_text(o: str = "options") -> str:
    return f"array_to_string(list_transform(range(len({o})), lambda i: chr(65 + i::INT)), ', ')"


def _lines(o: str, trimmed: bool = True) -> str:
    x = duck.strip("coalesce(x, 'None')") if trimmed else "coalesce(x, 'None')"
    return f"array_to_string(list_transform({o}, lambda x, i: chr(64 + i::INT) || '. ' || {x}), chr(10))"


_SLOTS = "coalesce(len(regexp_extract_all(question, '\\[ANS\\]')), 0)"
_SLOT_TASK = f"'This question has ' || {_SLOTS} || ' answer slots. Output exactly ' || {_SLOTS} || ' values, in order and comma-separated, inside one final \\boxed{{...}}.'"
_NL2 = "chr(10) || chr(10)"
_CHAT = "'<|im_start|>system' || chr(10) || 'You solve competition mathematics.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
_FREE = f"CASE WHEN {_SLOTS} >= 2 THEN question || {_NL2} || {_SLOT_TASK} ELSE question END"


def _mcq(task: str) -> str:
    return f"'Q: ' || question || {_NL2} || 'Options:' || chr(10) || {_lines('options')} || {_NL2} || 'Valid choices: [' || {_labels_text()} || '].' || chr(10) || {lit(task)}"


def _sql() -> dict[str, str]:
    out = {
        "q_all_boxed": f"SELECT line_no, len({duck.boxes('raw')}) AS n_boxes, array_to_string({duck.boxes('raw')}, '{SEP}') AS boxes FROM {R}",
        "q_last_boxed": f"SELECT line_no, coalesce(({duck.boxes('response')})[-1], '') AS box, len({duck.inners('response')}) > 0 AS has_box FROM {P}",
        "q_baseline_letter": f"SELECT line_no, {simple_letter_sql('response')} AS letter, {marked_letter_sql('response')} AS marked_letter, coalesce({duck.strip('(regexp_extract_all(response, ' + lit(chr(92) * 2 + 'boxed' + chr(92) + '{([^{}]+)' + chr(92) + '}') + ', 1))[-1]')}, '') AS flat_box FROM {P}",
        "q_visible_answer": f"SELECT line_no, CASE WHEN contains(raw, '</think>') OR contains(raw, '</redacted_reasoning>') THEN {duck.strip(_rx('raw', '(?s)^.*(?:</think>|</redacted_reasoning>)'))} ELSE raw END AS visible FROM {R}",
        "q_strip_thinking_v2": f"SELECT line_no, CASE WHEN contains(raw, '</think>') THEN {duck.strip('(string_split(raw, ' + lit('</think>') + '))[-1]')} WHEN contains(raw, '<think>') THEN '' ELSE {duck.strip('raw')} END AS text FROM {R}",
        "q_clean_tokens": f"SELECT line_no, {duck.strip(_rx(_rx('raw', chr(60) + chr(92) + '|[^|>]+' + chr(92) + '|>'), '</?think>'))} AS text FROM {R}",
        "q_training_echo": f"SELECT line_no, {' OR '.join(f'contains(left(raw, {letters.ECHO_HEAD}), {lit(p)})' for p in letters.TRAINING_ECHO)} AS echo FROM {R}",
        "q_valid_box_form": f"SELECT line_no, len({duck.inners('raw')}) = 1 AND len({duck.box_letters('raw', _V)}) = 1 AS strict_valid FROM {_MCQ_LINES} WHERE raw IS NOT NULL",
        "q_last_latex": f"SELECT line_no, {_latex('raw')} AS block FROM {R}",
        "q_answer_phrase": f"SELECT line_no, {_phrase('response')} AS phrase FROM {P}",
        "q_ensure_boxed": f"SELECT line_no, {_ensure('response')} AS text FROM {P}",
        "q_ans_slots": f"SELECT id, {_SLOTS} AS n_slots FROM {QUESTIONS}",
        "q_comma_values": f"SELECT id, array_to_string(list_filter(list_transform(string_split(answer, ','), lambda x: {duck.strip('x', _POINTS)}), lambda x: x <> ''), '{SEP}') AS parts FROM public_questions WHERE answer IS NOT NULL",
        "q_prompts": f"SELECT id, kind, prompt FROM (SELECT id, unnest(['mcq', 'mcq_strict', 'mcq_train']) AS kind, unnest([{_mcq(prompts.MCQ_TASK)}, 'Question:' || chr(10) || question || {_NL2} || 'Options:' || chr(10) || {_lines('options', False)} || {_NL2} || {lit(prompts.MCQ_STRICT_TASK)}, {_mcq(prompts.MCQ_TRAIN_TASK)}]) AS prompt FROM {QUESTIONS} WHERE len(options) > 0 UNION ALL SELECT id, unnest(['free', 'free_train', 'reasoning']), unnest([{_FREE}, question || {_NL2} || CASE WHEN {_SLOTS} >= 2 THEN {_SLOT_TASK} ELSE {lit(prompts.FREE_TRAIN_TASK)} END, question || {_NL2} || {lit(prompts.REASONING_TASK)}]) FROM {QUESTIONS} WHERE coalesce(len(options), 0) = 0)",
        "q_chat_template": f"SELECT id, {_CHAT.format('(' + _FREE + ')')} AS text, {_CHAT.format('question || ' + lit(' /no_think'))} AS quiet_text FROM {QUESTIONS}",
        "q_early_stop": f"SELECT line_no, regexp_matches(raw, {lit('(?i)FINAL' + chr(92) + 's*:' + chr(92) + 's*[A-J]' + chr(92) + 'b|' + chr(92) * 2 + 'boxed' + chr(92) + '{' + chr(92) + 's*[A-J]' + chr(92) + 's*' + chr(92) + '}')}) AS letter_stop, contains(raw, '</think>') AND len({duck.inners(_rx('raw', '(?s)^.*?</think>'))}) > 0 AS box_stop FROM {R}",
        "q_submission_format": f"WITH x AS (SELECT line_no, regexp_replace(coalesce(nullif(raw, ''), nullif(meta.raw, ''), ''), '\r\n?', '\n', 'g') AS r, regexp_replace(coalesce(response, ''), '\r\n?', '\n', 'g') AS a FROM private_outputs) SELECT line_no, CASE WHEN contains(r, '\\boxed') THEN r WHEN {duck.strip('r')} <> '' AND {duck.strip('a')} <> '' THEN r || {_NL2} || 'Final answer: ' || a WHEN {duck.strip('a')} <> '' THEN a ELSE r END AS text FROM x",
    }
    for name, e in (("q_valid_letter", duck.valid_letter("raw", _V)), ("q_first_letter", duck.valid_letter("raw", _V, 1)), ("q_tail_letter", duck.tail_letter("raw", _V)), ("q_last_valid_letter", f"coalesce(({duck.box_letters('raw', _V)})[-1], '')")):
        out[name] = f"SELECT line_no, {e} AS letter FROM {_MCQ_LINES} WHERE raw IS NOT NULL"
    o, e_ = "contains(raw, '<think>')", "contains(raw, '</think>')"
    before, after = duck.strip("string_split(raw, '</think>')[1]"), duck.strip(_rx("raw", "(?s)^.*?</think>"))
    first = f"CASE WHEN {o} AND {e_} THEN {after} WHEN {e_} THEN CASE WHEN {before} <> '' THEN {before} ELSE {after} END WHEN {o} THEN '' ELSE {duck.strip('raw')} END"
    out["q_strip_thinking_v1"] = f"SELECT line_no, {first} AS text FROM {R}"
    out["q_clean_visible"] = f"SELECT line_no, {duck.strip(_rx('t', chr(60) + chr(92) + '|[^|]+' + chr(92) + '|>'))} AS text FROM (SELECT line_no, {first} AS t FROM {R})"
    n, k = f"len({duck.inners('raw')})", f"len({duck.box_letters('raw', _V)})"
    inner = duck.inner_letter("x", _V)
    other = f"len(list_filter({duck.inners('raw')}, lambda x: {inner} = '' AND {duck.strip('x')} <> ''))"
    unsure = f"regexp_matches(raw, {lit(letters.UNCERTAIN)})"
    out["q_risk_score"] = (
        f"WITH x AS (SELECT line_no, {n} AS n, {k} AS k, {other} AS o, {unsure} AS u FROM {_MCQ_LINES} WHERE raw IS NOT NULL) SELECT line_no, (CASE WHEN n = 0 THEN 4 ELSE (n <> 1)::INT + 2 * (o > 0)::INT + 2 * (k <> 1)::INT + u::INT END)::INT AS score, "
        "CASE WHEN n = 0 THEN 'no_boxed_span' ELSE array_to_string(list_filter([CASE WHEN n <> 1 THEN 'multi_boxed' END, CASE WHEN o > 0 THEN 'nonletter_boxed' END, CASE WHEN k <> 1 THEN 'ambiguous_letter_spans' END, CASE WHEN u THEN 'uncertainty_phrase' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM x"
    )
    one = lit(duck.ONE_BOX)
    l = f"coalesce(({duck.box_letters('raw', _V)})[-1], '')"
    stripped = duck.rstrip(f"regexp_replace(raw, {one}, '', 'g')")
    out["q_mcq_canonical"] = f"WITH x AS (SELECT line_no, raw, {l} AS l, {stripped} AS b FROM {_MCQ_LINES} WHERE raw IS NOT NULL) SELECT line_no, CASE WHEN l = '' THEN raw WHEN b = '' THEN '\\boxed{{' || l || '}}' ELSE b || {_NL2} || '\\boxed{{' || l || '}}' END AS text, '\\boxed{{' || l || '}}' AS short FROM x"
    norm = "answer"
    for a, b in free.NORMALISE:
        norm = f"replace({norm}, {lit(a)}, {lit(b)})"
    for p, g in free.UNWRAP:
        norm = _rx(norm, p, f"\\{g}")
    norm = _rx(_rx(norm, "frac([^{])(.)", "frac{\\1}{\\2}"), "sqrt([^{])", "sqrt{\\1}")
    out["q_normalize_answer"] = f"SELECT id, {duck.strip(_rx(duck.strip(norm), '^' + chr(92) + '$+|' + chr(92) + '$+$'))} AS answer FROM public_questions WHERE answer IS NOT NULL"
    flat = lambda e: duck.strip(_rx(e, r"\\boxed\s*\{[^{}]*\}"))
    t = duck.strip("response")
    out["q_single_final_box"] = (
        f"WITH x AS (SELECT line_no, {t} AS t, {duck.strip(chr(99) + 'oalesce(meta.boxed, ' + chr(39) * 2 + ')')} AS f FROM {P}), y AS (SELECT *, coalesce(nullif(({duck.boxes('t')})[-1], ''), f) AS v, {_ensure('t')} AS e FROM x), z AS (SELECT line_no, CASE WHEN v <> '' THEN v ELSE coalesce(({duck.boxes('e')})[-1], '') END AS v, CASE WHEN v <> '' THEN {flat('t')} ELSE {flat('e')} END AS b FROM y) "
        f"SELECT line_no, CASE WHEN b = '' THEN '\\boxed{{' || v || '}}' ELSE b || {_NL2} || '\\boxed{{' || v || '}}' END AS text FROM z"
    )
    first = f"regexp_extract(raw, {lit('(?s)^(.*?' + duck.ONE_BOX + ')')}, 1)"
    gap = f"(regexp_split_to_array(raw, {one}))[-1]"
    out["q_box_cuts"] = f"SELECT line_no, {duck.rstrip(f'CASE WHEN {first} = {lit(str())} THEN raw ELSE {first} END')} AS first_cut, {duck.rstrip(f'CASE WHEN len({duck.inners(chr(114) + chr(97) + chr(119))}) > 0 THEN left(raw, length(raw) - length({gap})) ELSE raw END')} AS last_cut FROM {R}"
    visible = f"CASE WHEN contains(raw, '</think>') OR contains(raw, '</redacted_reasoning>') THEN {duck.strip(_rx('raw', '(?s)^.*(?:</think>|</redacted_reasoning>)'))} ELSE raw END"
    m1 = duck.strip(f"coalesce({', '.join(f'(regexp_extract_all(v, {lit(p)}, 1))[-1]' for p in free.MULTI_PHRASES)}, '')", _POINTS)
    m2 = duck.strip(_rx(_rx(_rx(_rx("a", r"^\\\[\s*", "", ""), r"\s*\\\]$", "", ""), r"(?s)^\$\$(.*)\$\$$", "\\1", ""), r"(?s)^\$(.*)\$$", "\\1", ""), _POINTS)
    m3 = duck.strip(f"coalesce(({duck.boxes('b')})[-1], b)", _POINTS)
    parts = f"list_filter(list_transform(string_split(c, ','), lambda x: {duck.strip('x', _POINTS)}), lambda x: x <> '')"
    out["q_multi_values"] = (
        f"WITH l AS (SELECT o.line_no, {_SLOTS} AS slots, {visible} AS v FROM private_outputs o JOIN {QUESTIONS} q ON o.id = q.id WHERE coalesce(len(q.options), 0) = 0 AND o.raw IS NOT NULL), x AS (SELECT *, {m1} AS a FROM l), y AS (SELECT *, {m2} AS b FROM x), z AS (SELECT *, {m3} AS c FROM y), w AS (SELECT *, {parts} AS p FROM z) "
        f"SELECT line_no, CASE WHEN slots >= 2 AND len(p) = slots THEN array_to_string(p, '{SEP}') ELSE '' END AS parts, CASE WHEN slots >= 2 AND len(p) = slots THEN len(p) ELSE 0 END AS n_values FROM w"
    )
    values = lambda e: f"list_filter(list_transform(string_split({e}, ','), lambda x: {duck.strip('x', _POINTS)}), lambda x: x <> '')"
    seen = f"right(array_to_string(list_transform(range(1, i + 1), lambda j: gaps[j] || CASE WHEN j < i THEN '\\boxed{{' || inn[j] || '}}' ELSE '' END), ''), {free.CUE_WINDOW})"
    out["q_free_canonical"] = (
        f"WITH l AS (SELECT o.line_no, o.raw, {_SLOTS} AS slots, {visible} AS v FROM private_outputs o JOIN {QUESTIONS} q ON o.id = q.id WHERE coalesce(len(q.options), 0) = 0 AND o.raw IS NOT NULL), x AS (SELECT *, {m1} AS a, {_ensure('raw')} AS e FROM l), y AS (SELECT *, {m2} AS b, {duck.inners('e')} AS inn, regexp_split_to_array(e, {one}) AS gaps FROM x), z AS (SELECT *, {m3} AS c FROM y), "
        f"w AS (SELECT line_no, slots, {values('c')} AS p, {values(duck.strip('inn[-1]'))} AS lastp, inn, list_filter(range(1, len(inn) + 1), lambda i: regexp_matches({seen}, {lit(free.CUE)})) AS cued FROM z), "
        "k AS (SELECT *, CASE WHEN slots >= 2 AND len(p) = slots THEN 'free_multi_ans_phrase' WHEN slots >= 2 AND len(lastp) = slots THEN 'free_multi_ans_last_box' WHEN len(cued) > 0 THEN 'free_cue_last' ELSE 'free_last_boxed' END AS path FROM w) "
        f"SELECT line_no, path, '\\boxed{{' || CASE path WHEN 'free_multi_ans_phrase' THEN array_to_string(p, ', ') WHEN 'free_multi_ans_last_box' THEN array_to_string(lastp, ', ') WHEN 'free_cue_last' THEN {duck.strip('inn[cued[-1]]')} ELSE coalesce({duck.strip('inn[-1]')}, '') END || '}}' AS response, CASE path WHEN 'free_multi_ans_phrase' THEN array_to_string(p, '{SEP}') WHEN 'free_multi_ans_last_box' THEN array_to_string(lastp, '{SEP}') ELSE '' END AS parts FROM k"
    )
    out["q_option_phrase"] = f"SELECT line_no, {duck.option_phrase('raw', _V)} AS letter FROM {_MCQ_LINES} WHERE raw IS NOT NULL"
    out["q_primary_pass"] = f"SELECT line_no, letter, path FROM {primary_sql()}"
    out["q_signal_guess"] = best_guess_sql()
    return out


def primary_sql(before: str = "coalesce(meta.raw, raw, '')") -> str:
    """(line_no, id, raw, valid, letter, path) of the first pass."""
    texts = {"r": "raw", "v": "v", "b": "before", "w": "w"}
    cols = ", ".join(f"{duck.last_letter(t, _V)} AS {k}_box, {duck.option_phrase(t, _V)} AS {k}_opt, {duck.valid_letter(t, _V)} AS {k}_any" for k, t in texts.items())
    steps = [("true", "r_box", "mcq_last_valid_letter")]
    for k in "vr":
        steps += [("true", f"{k}_opt", "mcq_raw_option_phrase"), ("true", f"{k}_any", "mcq_primary_phrase_fulltext")]
    steps += [("changed", "b_box", "mcq_primary_pre_trunc_last_valid_letter")]
    for k in "wb":
        steps += [("changed", f"{k}_opt", "mcq_primary_pre_trunc_raw_option_phrase"), ("changed", f"{k}_any", "mcq_primary_pre_trunc_phrase")]
    letter, path = duck.first_step([(f"NOT echo AND {c}", *x) for c, *x in steps], ("''", "'mcq_last_valid_letter'"))
    return (
        f"(WITH a AS (SELECT line_no, id, valid, coalesce(raw, '') AS raw, {before} AS before FROM {_MCQ_LINES}), c AS (SELECT *, {duck.visible('raw')} AS v, {duck.visible('before')} AS w, {duck.strip('before')} <> {duck.strip('raw')} AS changed, {duck.echo('raw')} AS echo FROM a), "
        f"d AS (SELECT *, {cols} FROM c) SELECT *, {letter} AS letter, {path} AS path FROM d)"
    )


def best_guess_sql() -> str:
    texts = {"f": "f", "fv": duck.visible("f"), "p": "p", "pv": duck.visible("p"), "b": "b", "bv": duck.visible("b"), "c": "c", "cv": duck.visible("c"), "l": "l", "lv": duck.visible("l")}
    box = lambda k, path: (f"{k}_box", path, guess.BOX)
    medium = lambda col, path: (col, path, guess.PHRASE)
    steps = []
    for c, k, first, stem, option in (("true", "f", "mcq_finalizer_last_valid_letter", "mcq_finalizer", "mcq_finalizer_raw_option_phrase"), ("NOT echo", "p", "mcq_last_valid_letter", "mcq_primary", "mcq_raw_option_phrase")):
        steps += [(c, *box(k, first)), (c, *medium(f"{k}_tail", f"{stem}_tail_phrase")), (c, *medium(f"{k}_opt", option)), (c, *medium(f"{k}v_any", f"{stem}_phrase_fulltext")), (c, *medium(f"{k}_any", f"{stem}_phrase_fulltext"))]
    n, m = "NOT echo AND changed", "NOT echo"
    steps += [(n, *box("b", "mcq_pre_trunc_last_valid_letter")), (n, *medium("b_opt", "mcq_pre_trunc_raw_option_phrase")), (n, *medium("bv_any", "mcq_pre_trunc_phrase_fulltext")), (n, *medium("b_any", "mcq_pre_trunc_phrase_fulltext")), (m, *medium("c_opt", "mcq_combined_raw_option_phrase"))]
    for k in ("cv", "c"):
        steps += [(m, *medium(f"{k}_any", "mcq_combined_phrase_fulltext")), (m, *medium(f"{k}_tail", "mcq_combined_tail_phrase"))]
    steps += [(n, *medium("lv_any", "mcq_combined_pre_trunc_phrase")), (n, *medium("l_any", "mcq_combined_pre_trunc_phrase"))]
    used = {x[1] for x in steps}
    make = {"box": duck.last_letter, "tail": duck.tail_letter, "opt": duck.option_phrase, "any": duck.valid_letter}
    cols = ", ".join(f"{make[u.split('_')[1]](u.split('_')[0] + '_t', _V)} AS {u}" for u in sorted(used))
    letter, path, tier = duck.first_step(steps, ("''", "'mcq_abstain_no_signal'", lit(guess.NO_TIER)))
    return (
        f"WITH a AS (SELECT line_no, valid, coalesce(raw, '') AS p, coalesce(meta.raw, '') AS b, coalesce(response, '') AS f FROM {_MCQ_LINES}), a2 AS (SELECT *, p || {_NL2} || f AS c, b || {_NL2} || f AS l, {duck.strip('b')} <> {duck.strip('p')} AS changed, {duck.echo('p')} AS echo FROM a), "
        f"a3 AS (SELECT *, {', '.join(f'{t} AS {k}_t' for k, t in texts.items())} FROM a2), d AS (SELECT *, {cols} FROM a3) SELECT line_no, {letter} AS letter, {path} AS path, {tier} AS tier FROM d"
    )


def single_final_box_sql(t: str, f: str) -> str:
    """One box at the end, for texts t (stripped) and fallbacks f (stripped)."""
    flat = lambda e: duck.strip(_rx(e, r"\\boxed\s*\{[^{}]*\}"))
    v = f"coalesce(nullif(({duck.boxes(t)})[-1], ''), {f})"
    e = _ensure(t)
    last = f"coalesce(({duck.boxes(f'({e})')})[-1], '')"
    put = lambda b, x: f"CASE WHEN {b} = '' THEN '\\boxed{{' || {x} || '}}' ELSE {b} || {_NL2} || '\\boxed{{' || {x} || '}}' END"
    return f"CASE WHEN {v} <> '' THEN {put(flat(t), v)} ELSE {put(flat(f'({e})'), last)} END"


SQL = _sql()
QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}
