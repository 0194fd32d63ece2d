"""Queries of the judge, each kind of answer for itself and all together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.boxed import extract_boxed
from marginalia.functions.letters import labels, simple_letter
from marginalia.functions.text import strip
from marginalia.judge.methods import option_match, verdicts
from marginalia.judge.normal import FALSE, PLUS_MINUS, TRUE, WEEKDAYS
from marginalia.judge.plan import judged
from marginalia.operators.curate import answer_to_letter
from marginalia.plans import duck
from marginalia.plans.duck import LAST, QUESTIONS, lit
from marginalia.plans.relational import is_mcq, questions, records
from marginalia.plans.texts import simple_letter_sql
from marginalia.session import ship, table


def answered(spark: SparkSession, d: str) -> DataFrame:
    """Last lines of public questions with an answer: id, mcq, answer, response, box."""
    q = table(spark, d, "public_questions").where("answer is not null").select("id", "options", is_mcq().alias("mcq"), "answer")
    r = records(spark, d).select("id", F.coalesce("response", F.lit("")).alias("response"), "raw", "meta")
    return q.join(r, "id").withColumn("box", extract_boxed(F.col("response")))


_ANSWERED = f"(SELECT q.id, q.options, {'coalesce(len(q.options), 0) > 0'} AS mcq, q.answer, coalesce(r.response, '') AS response, r.raw, r.meta, coalesce(({duck.boxes(chr(99) + 'oalesce(r.response, ' + chr(39) * 2 + ')')})[-1], '') AS box FROM public_questions q JOIN {LAST} r ON q.id = r.id WHERE q.answer IS NOT NULL)"


def q_judge_exact(spark, d):
    return answered(spark, d).select("id", (F.lower("box") == F.lower("answer")).alias("ok"))


def _by_kind(spark, d, code, rows="true"):
    """The judge of a kind over boxes and answers."""
    ship(spark)
    return answered(spark, d).where(rows).select("id", verdicts(code)("box", "answer").alias("ok"))


_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def q_judge_nv(spark, d):
    """Numbers in plain notation."""
    return _by_kind(spark, d, "NV", F.col("box").rlike(_NUMBER) & F.col("answer").rlike(_NUMBER))


def q_judge_mcm(spark, d):
    """Letters chosen together, as multisets."""
    return _by_kind(spark, d, "MCM", F.col("mcq"))


def q_judge_mcs(spark, d):
    """One letter, perhaps before a colon."""
    return _by_kind(spark, d, "MCS", F.col("mcq"))


def _truth(c):
    w = strip(F.lower(c))
    return F.when(w.isin(*sorted(TRUE)), "True").when(w.isin(*sorted(FALSE)), "False")


def q_judge_tf(spark, d):
    """Truths in words, judged once both are True or False."""
    ship(spark)
    x = answered(spark, d).select("id", _truth("box").alias("pred"), _truth("answer").alias("gold"))
    return x.withColumn("ok", verdicts("TF")(F.coalesce("pred", F.lit("")), F.coalesce("gold", F.lit(""))))


def q_weekdays(spark, d):
    """Names of weekdays among the words of the questions, in one form."""
    day = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(WEEKDAYS.items()) for x in kv]), F.col("word"))
    words = F.explode(F.regexp_extract_all(F.lower("question"), F.lit("([a-z]+)"), F.lit(1))).alias("word")
    return questions(spark, d).select("id", words).select("id", F.when(F.col("word").isin(*WEEKDAYS), F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(WEEKDAYS.items()) for x in kv]), F.col("word"))).alias("weekday")).where("weekday is not null").groupBy("weekday").agg(F.count("*").alias("n_words"), F.count_distinct("id").alias("n_questions"))


def q_clean_answer(spark, d):
    """Answers without punctuation at their ends; a backslash that opens a command stays."""
    a = F.regexp_replace(strip(F.col("answer")), r"^(?:\\(?![A-Za-z])|[,.:;!?=+\-×÷*/|\s])+", "")
    return table(spark, d, "public_questions").where("answer is not null").select("id", F.regexp_replace(a, r"[,.:;!?=\\。，、；：！？\s]+$", "").alias("answer"))


def q_plus_minus(spark, d):
    """a ± b as both of its values, over formulas made from the answers."""
    p = F.concat(F.col("answer"), F.lit("\\pm"), F.col("id").cast("string"))
    return table(spark, d, "public_questions").where("answer is not null").select("id", F.regexp_replace(p, PLUS_MINUS.pattern, "$1-$2,$1+$2").alias("text"))


def q_score_mcq(spark, d):
    """The simple score: a box of one letter, or the last letter that stands alone, against the gold letter."""
    return answered(spark, d).where("mcq").select("id", (simple_letter(F.col("response")) == F.upper(strip(F.col("answer")))).alias("ok"))


def with_verdict(df: DataFrame) -> DataFrame:
    return judged(df.withColumn("gold", F.array("answer")), "response", "gold")


def q_judge_auto(spark, d):
    """All kinds together; what the JVM decides never meets Python."""
    return with_verdict(answered(spark, d)).select("id", "mcq", "ok")


def q_option_match(spark, d):
    """Free texts matched with the text of an option."""
    ship(spark)
    q = questions(spark, d).where(is_mcq()).select("id", "options")
    return q.join(records(spark, d).select("id", "raw").where("raw is not null"), "id").select("id", option_match("raw", "options").alias("letter"))


def q_map_answer(spark, d):
    """Gold answers of any writing as letters, or the reason why not."""
    x = questions(spark, d).where(is_mcq()).where("origin = 'public'")
    m = answer_to_letter(F.col("answer"), F.col("options"), labels(F.col("options")))
    return x.select("id", m["letter"].alias("letter"), m["reason"].alias("reason"))


_TRUE, _FALSE = (", ".join(lit(w) for w in sorted(s)) for s in (TRUE, FALSE))
_T = lambda c: f"CASE WHEN {duck.strip(f'lower({c})')} IN ({_TRUE}) THEN 'True' WHEN {duck.strip(f'lower({c})')} IN ({_FALSE}) THEN 'False' END"
_NUM = "'^-?[0-9]+(\\.[0-9]+)?$'"
_LABELS = duck.labels("options")
_COMPACT = f"upper({duck.strip('answer', '()' + chr(92) + '[' + chr(92) + ']{}')})"
SQL = {
    "q_judge_exact": f"SELECT id, lower(box) = lower(answer) AS ok FROM {_ANSWERED}",
    "q_judge_nv": f"WITH x AS (SELECT id, box, answer, try_cast(box AS DOUBLE) AS p, try_cast(answer AS DOUBLE) AS g FROM {_ANSWERED} WHERE regexp_matches(box, {_NUM}) AND regexp_matches(answer, {_NUM})) SELECT id, box = answer OR p = g OR coalesce(abs((p - round(g, 6)) / nullif(round(g, 6), 0)) <= 1.01e-8, false) OR coalesce(abs((p - g) / nullif(g, 0)) <= 1.01e-8, false) AS ok FROM x",
    "q_judge_mcm": f"SELECT id, answer <> '' AND array_to_string(list_sort(regexp_extract_all(box, '[A-Z]')), '') = array_to_string(list_sort(string_split(upper(answer), '')), '') AS ok FROM {_ANSWERED} WHERE mcq",
    "q_judge_mcs": f"WITH x AS (SELECT id, box, answer, CASE WHEN box LIKE '[%' AND box LIKE '%]' THEN trim(box, '[]') ELSE box END AS b FROM {_ANSWERED} WHERE mcq) SELECT id, lower(box) = lower(answer) OR lower(b) = lower(answer) OR (regexp_extract(b, '^([A-Z]):', 1) <> '' AND regexp_extract(b, '^([A-Z]):', 1) = answer) AS ok FROM x",
    "q_judge_tf": f"SELECT id, {_T('box')} AS pred, {_T('answer')} AS gold, coalesce({_T('box')} = {_T('answer')}, false) AS ok FROM {_ANSWERED}",
    "q_weekdays": f"WITH m AS (SELECT unnest([{', '.join(lit(k) for k in sorted(WEEKDAYS))}]) AS word, unnest([{', '.join(lit(WEEKDAYS[k]) for k in sorted(WEEKDAYS))}]) AS weekday), w AS (SELECT id, unnest(regexp_extract_all(lower(question), '[a-z]+')) AS word FROM {QUESTIONS}) SELECT weekday, count(*) AS n_words, count(DISTINCT id) AS n_questions FROM w JOIN m USING (word) GROUP BY weekday",
    "q_plus_minus": f"SELECT id, regexp_replace(answer || '\\pm' || id, {lit(PLUS_MINUS.pattern)}, '\\1-\\2,\\1+\\2', 'g') AS text FROM public_questions WHERE answer IS NOT NULL",
    "q_score_mcq": f"SELECT id, {simple_letter_sql('response')} = upper({duck.strip('answer')}) AS ok FROM {_ANSWERED} WHERE mcq",
    "q_map_answer": (
        f"WITH x AS (SELECT id, answer, options, {_LABELS} AS valid, {duck.strip('answer')} AS t, {_COMPACT} AS c FROM public_questions WHERE len(options) > 0), y AS (SELECT *, {duck.valid_letter('t', 'valid')} AS l, list_filter(range(len(options)), lambda i: lower({duck.strip('options[i + 1]')}) = lower(t)) AS hits FROM x) "
        "SELECT id, CASE WHEN answer IS NULL OR t = '' THEN '' WHEN length(c) = 1 AND list_contains(valid, c) THEN c WHEN regexp_matches(t, '^[0-9]+$') THEN CASE WHEN try_cast(t AS BIGINT) < len(options) THEN chr(65 + try_cast(t AS INT)) ELSE '' END WHEN l <> '' THEN l WHEN len(hits) = 1 THEN chr(65 + hits[1]::INT) ELSE '' END AS letter, "
        "CASE WHEN answer IS NULL THEN 'missing_answer' WHEN t = '' THEN 'empty_answer' WHEN length(c) = 1 AND list_contains(valid, c) THEN '' WHEN regexp_matches(t, '^[0-9]+$') THEN CASE WHEN try_cast(t AS BIGINT) < len(options) THEN '' ELSE 'answer_index_out_of_range' END WHEN l <> '' THEN '' WHEN len(hits) = 1 THEN '' WHEN len(hits) > 1 THEN 'ambiguous_answer_text_duplicate_choice' ELSE 'answer_unmapped' END AS reason FROM y"
    ),
}
QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}
