"""Queries over spans, labelling functions and prompts."""

import re

import pandas as pd
from pyspark.sql import functions as F

from clinspark.functions.text import DATE_REGEX, accent_table, char_context, resolve_date
from clinspark.operators import lfs, spans as sp
from clinspark.operators.stored import stored
from clinspark.plans import labelling as lb
from queries import adapters as ad
from queries.adapters import with_ctes
from queries.registry import query

MONTHS_SHOWN = ["janvier", "Février", "mars", "AVRIL", "mai", "juin", "Juillet", "Août", "septembre", "octobre", "novembre", "DÉCEMBRE"]
SPAN_LIST = 'note_id, label, lexical_variant, start, "end", span_id'


@query("lf_extract_spans", with_ctes(f"SELECT {SPAN_LIST} FROM span", "span"))
def lf_extract_spans(spark, d):
    return ad.spans(spark, d).select("note_id", "label", "lexical_variant", "start", "end", "span_id")


@query(
    "lf_date_spans",
    f"""WITH mention AS (SELECT o_orderkey AS note_id, 'Le ' || strftime(o_orderdate, '%d/%m/%Y') || ' biopsie. Puis le ' || day(o_orderdate) || ' ' || {[*MONTHS_SHOWN]}[month(o_orderdate)]
        || ' ' || year(o_orderdate) || ', TEP. Vu le ' || strftime(o_orderdate, '%Y-%m-%d') || '; lot 1' || strftime(o_orderdate, '%d/%m/%Y') || '7.' AS note_text FROM orders),
      folded AS (SELECT *, lower(translate(note_text, '{accent_table()[0]}', '{accent_table()[1]}')) AS t FROM mention),
      found AS (SELECT note_id, note_text, regexp_extract_all(t, '{DATE_REGEX}') AS m, regexp_split_to_array(t, '{DATE_REGEX}') AS g FROM folded),
      one AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM found),
      placed AS (SELECT note_id, note_text, m[i] AS v,
        CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0) AS INTEGER) AS start FROM one)
    SELECT note_id, substr(note_text, start + 1, length(v)) AS lexical_variant, start FROM placed""",
)
def lf_date_spans(spark, d):
    order_date = F.col("o_orderdate")
    text = F.concat(
        F.lit("Le "), F.date_format(order_date, "dd/MM/yyyy"), F.lit(" biopsie. Puis le "), F.dayofmonth(order_date).cast("string"),
        F.lit(" "), F.element_at(F.array(*[F.lit(m) for m in MONTHS_SHOWN]), F.month(order_date)), F.lit(" "),
        F.year(order_date).cast("string"), F.lit(", TEP. Vu le "), F.date_format(order_date, "yyyy-MM-dd"),
        F.lit("; lot 1"), F.date_format(order_date, "dd/MM/yyyy"), F.lit("7."),
    )
    notes = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), text.alias("note_text"))
    return sp.extract_spans(notes).select("note_id", "lexical_variant", "start")


SENTENCES = r"""SELECT note_id, CAST(i - 1 AS INTEGER) AS sentence_id, md5(piece) AS sentence, CAST(coalesce(list_sum(list_transform(parts[1:i-1], lambda z: length(z))), 0) AS INTEGER) AS start, length(piece) AS n
  FROM (SELECT note_id, parts, i, parts[i] AS piece FROM (SELECT note_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (
    SELECT note_id, string_split(regexp_replace(note_text, '([.!?]+[ \t\r\n]|\n)', E'\\1\x01', 'g'), E'\x01') AS parts FROM note))) WHERE piece <> ''"""


@query(
    "lf_sentences",
    with_ctes(SENTENCES, "note"),
)
def lf_sentences(spark, d):
    rows = sp.sentences(ad.notes(spark, d))
    length = (F.col("end") - F.col("start")).cast("bigint")
    return rows.select("note_id", "sentence_id", F.md5("sentence").alias("sentence"), "start", length.alias("n"))


@query(
    "sc_char_context",
    with_ctes(
        'SELECT span_id, md5(substr(note_text, greatest(start - 75, 0) + 1, "end" + 75 - greatest(start - 75, 0))) AS context FROM span', "span"
    ),
)
def sc_char_context(spark, d):
    rows = ad.spans(spark, d, {"context": sp.ContextWindow(chars=75)})
    return rows.select("span_id", F.md5("context").alias("context"))


@query(
    "sc_char_context_text",
    "SELECT doc_id, md5(substr(text, greatest(n_chars // 2 - 100, 0) + 1, n_chars // 2 + 10 + 100 - greatest(n_chars // 2 - 100, 0))) AS context FROM documents",
)
def sc_char_context_text(spark, d):
    middle = F.floor(F.col("n_chars") / 2)
    docs = ad.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(char_context("text", middle, middle + 10, 100)).alias("context"))


@query(
    "sc_ids",
    with_ctes(
        """SELECT span_id, note_id || '-' || start || '-' || "end" || '-' || label || '-task' AS ext_id, 'automatic-' || label || '-' || start || '-' || "end" AS auto_id FROM span""", "span"
    ),
)
def sc_ids(spark, d):
    from clinspark.functions.keys import joined_id

    return ad.spans(spark, d).select(
        "span_id", joined_id("note_id", "start", "end", "label", F.lit("task")).alias("ext_id"), joined_id(F.lit("automatic"), "label", "start", "end").alias("auto_id")
    )


@query(
    "lf_preannotate",
    with_ctes(
        """SELECT CAST(n.note_id AS VARCHAR) AS note_id, CAST(n.note_date AS VARCHAR) AS note_date, false AS seen, CAST(count(start) AS INTEGER) AS n_entities,
        md5(coalesce(string_agg('automatic-' || label || '-' || start || '-' || "end" || ':' || lexical_variant, '|' ORDER BY start, "end", label), '')) AS entities
        FROM note n LEFT JOIN span s ON s.note_id = n.note_id GROUP BY n.note_id, n.note_date""",
        "span",
    ),
)
def lf_preannotate(spark, d):
    rows = sp.preannotate(ad.notes(spark, d), ad.SPAN_PATTERNS)
    text = F.array_join(F.transform("entities", lambda e: F.concat(e["id"], F.lit(":"), e["text"])), "|")
    return rows.select("note_id", "note_date", "seen", F.size("entities").alias("n_entities"), F.md5(text).alias("entities"))


# ---------------------------------------------------------------- knowledge votes


def _stored_spans(spark, d):
    """Spans as the votes need them, written once: they are counted before they are joined."""
    return stored(ad.spans(spark, d).select("span_id", "person_id", "note_date"))


@query(
    "lf_external",
    with_ctes(
        """SELECT span_id, string_agg(DISTINCT class, '|' ORDER BY class) AS votes FROM span s LEFT JOIN knowledge k ON k.person_id = s.person_id AND k.event_date = s.note_date GROUP BY 1""",
        "span",
        "knowledge",
    ),
)
def lf_external(spark, d):
    rows = lfs.external_lf(_stored_spans(spark, d), ad.knowledge_rows(spark, d), "votes", "note_date")
    return rows.select("span_id", F.array_join("votes", "|").alias("votes"))


@query(
    "lf_dates_external",
    with_ctes(
        f"""SELECT note_id, lexical_variant, string_agg(DISTINCT class, '|' ORDER BY class) AS votes FROM (
          SELECT note_id, person_id, note_date AS day, day(note_date) || ' ' || {[*MONTHS_SHOWN]}[month(note_date)] || ' ' || year(note_date) AS lexical_variant FROM note
          UNION ALL SELECT note_id, person_id, note_date + 3, strftime(note_date + 3, '%Y-%m-%d') FROM note) m
        LEFT JOIN knowledge k ON k.person_id = m.person_id AND abs(k.event_date - m.day) <= 1 GROUP BY ALL""",
        "note",
        "knowledge",
    ),
)
def lf_dates_external(spark, d):
    """Text -> date mentions -> resolved dates -> votes of the events near them."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS_SHOWN]), F.month("note_date"))
    worded = F.concat_ws(" ", F.dayofmonth("note_date").cast("string"), month, F.year("note_date").cast("string"))
    text = F.concat(F.lit("TEP le "), worded, F.lit(", contrôle le "), F.date_format(F.date_add("note_date", 3), "yyyy-MM-dd"), F.lit("."))
    mentions = ad.notes(spark, d).select("note_id", "person_id", "note_date", text.alias("note_text"))
    spans = sp.extract_spans(mentions, keys=("note_id", "person_id", "note_date"))
    dated = spans.withColumn("span_date", resolve_date("lexical_variant", "note_date"))
    rows = lfs.external_lf(stored(dated), ad.knowledge_rows(spark, d), "votes", "span_date", 1)
    return rows.select("note_id", "lexical_variant", F.array_join("votes", "|").alias("votes"))


@query(
    "j_temporal_exact",
    with_ctes(
        """SELECT span_id, string_agg(DISTINCT class, '|' ORDER BY class) FILTER (lf = 'lf_ccam') AS lf_ccam, string_agg(DISTINCT class, '|' ORDER BY class) FILTER (lf = 'lf_imaging_md') AS lf_imaging_md
        FROM span s LEFT JOIN knowledge k ON k.person_id = s.person_id AND k.event_date = s.note_date GROUP BY 1""",
        "span",
        "knowledge",
    ),
)
def j_temporal_exact(spark, d):
    rows = lfs.external_lfs(_stored_spans(spark, d), ad.knowledge_rows(spark, d), ["lf_ccam", "lf_imaging_md"], "note_date")
    return rows.select("span_id", F.array_join("lf_ccam", "|").alias("lf_ccam"), F.array_join("lf_imaging_md", "|").alias("lf_imaging_md"))


@query(
    "j_temporal_window",
    with_ctes(
        """SELECT span_id, string_agg(DISTINCT class, '|' ORDER BY class) AS votes FROM span s LEFT JOIN knowledge k ON k.person_id = s.person_id AND abs(k.event_date - s.note_date) <= 2 GROUP BY 1""",
        "span",
        "knowledge",
    ),
)
def j_temporal_window(spark, d):
    rows = lfs.external_lf(_stored_spans(spark, d), ad.knowledge_rows(spark, d), "votes", "note_date", 2)
    return rows.select("span_id", F.array_join("votes", "|").alias("votes"))


@query(
    "j_notes_knowledge",
    with_ctes("SELECT note_id FROM note WHERE person_id IN (SELECT person_id FROM knowledge WHERE lf = 'lf_ccam')", "note", "knowledge"),
)
def j_notes_knowledge(spark, d):
    events = ad.knowledge_rows(spark, d).filter("lf = 'lf_ccam'")
    return ad.notes(spark, d).join(events.select("person_id").distinct(), "person_id", "left_semi").select("note_id")


# ---------------------------------------------------------------- pattern votes

PLACED = """SELECT s.span_id, s.label, s.note_id, s.start, s."end", t.sentence_id FROM span s JOIN sentence_row t ON t.note_id = s.note_id AND s.start >= t.start AND s.start < t.start + t.n"""
SENTENCE_ROWS = SENTENCES.replace("md5(piece) AS sentence", "piece AS sentence")
TERM = r"(?:^|[^\p{L}\p{N}_])(?:%s)(?:$|[^\p{L}\p{N}_])"

LF_TERMS = lfs.PatternLF("lf_terms", "Biopsy (procedure)", terms=("the", "und", "e-mail"), window=sp.ContextWindow(sentences=1))
LF_REGEX = lfs.PatternLF("lf_regex", "Imaging (procedure)", regexes=("(?i)[0-9]{2,}", "ing (?:on|of)"), window=sp.ContextWindow(sentences=(1, 2), norm=True))
LF_FOLDED = lfs.PatternLF("lf_folded", "Endoscopy (procedure)", terms=("dés", "für", "que"), window=sp.ContextWindow(sentences=(2, 1), norm=True))
LF_WORDS = lfs.PatternLF("lf_words", "Mammography (procedure)", terms=("and", "les", "der"), window=sp.ContextWindow(words=(3, 2)))


def _pattern_votes(spark, d, functions):
    return lfs.pattern_voted_spans(ad.notes(spark, d), functions, ad.SPAN_PATTERNS, ad.SPAN_KEYS)


@query(
    "lf_pattern_terms",
    with_ctes(
        f"""SELECT p.span_id, CASE WHEN regexp_matches(t.sentence, '{TERM % "the|und|e-mail"}') THEN 'Biopsy (procedure)' END AS lf_terms
        FROM placed p JOIN sentence_row t ON t.note_id = p.note_id AND t.sentence_id = p.sentence_id""",
        "span",
        sentence_row=SENTENCE_ROWS,
        placed=PLACED,
    ),
)
def lf_pattern_terms(spark, d):
    return _pattern_votes(spark, d, [LF_TERMS]).select("span_id", "lf_terms")


@query(
    "lf_pattern_regex",
    with_ctes(
        f"""SELECT p.span_id,
          CASE WHEN regexp_matches(lower(translate(string_agg(t.sentence, '' ORDER BY t.sentence_id) FILTER (t.sentence_id >= p.sentence_id), '{ad._FROM}', '{ad._TO}')), '[0-9]{{2,}}|ing (?:on|of)') THEN 'Imaging (procedure)' END AS lf_regex,
          CASE WHEN regexp_matches(lower(translate(string_agg(t.sentence, '' ORDER BY t.sentence_id) FILTER (t.sentence_id <= p.sentence_id), '{ad._FROM}', '{ad._TO}')), '{TERM % "des|fur|que"}') THEN 'Endoscopy (procedure)' END AS lf_folded
        FROM placed p JOIN sentence_row t ON t.note_id = p.note_id AND t.sentence_id BETWEEN p.sentence_id - 1 AND p.sentence_id + 1 GROUP BY p.span_id""",
        "span",
        sentence_row=SENTENCE_ROWS,
        placed=PLACED,
    ),
)
def lf_pattern_regex(spark, d):
    return _pattern_votes(spark, d, [LF_REGEX, LF_FOLDED]).select("span_id", "lf_regex", "lf_folded")


WORDS = r"""SELECT note_id, i AS word_id, parts[i] AS piece, CAST(coalesce(sum(length(parts[i])) OVER (PARTITION BY note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT note_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (
    SELECT note_id, string_split(regexp_replace(note_text, '([ \t\r\n]+)', E'\\1\x01', 'g'), E'\x01') AS parts FROM note))"""
WORD_AT = """SELECT s.span_id, s.note_id, w.word_id FROM span s JOIN word_row w ON w.note_id = s.note_id AND s.start >= w.start AND s.start < w.start + length(w.piece)"""


@query(
    "lf_pattern_words",
    with_ctes(
        f"""SELECT p.span_id, CASE WHEN regexp_matches(string_agg(w.piece, '' ORDER BY w.word_id), '{TERM % "and|les|der"}') THEN 'Mammography (procedure)' END AS lf_words
        FROM word_at p JOIN word_row w ON w.note_id = p.note_id AND w.word_id BETWEEN p.word_id - 3 AND p.word_id + 2 GROUP BY p.span_id""",
        "span",
        word_row=WORDS,
        word_at=WORD_AT,
    ),
)
def lf_pattern_words(spark, d):
    return _pattern_votes(spark, d, [LF_WORDS]).select("span_id", "lf_words")


LOGICAL_RULES = [
    {"name": "logical_1", "lf_in": {"lf_terms": "Biopsy (procedure)", "lf_regex": "Imaging (procedure)"}, "relation": "lf_terms and lf_regex", "value_out": True},
    {"name": "logical_2", "lf_in": {"lf_terms": "Biopsy (procedure)", "lf_folded": "Endoscopy (procedure)"}, "relation": "not lf_terms or (lf_folded and lf_terms)", "value_out": "Endoscopy (procedure)"},
    {"name": "logical_3", "lf_in": {"logical_1": True, "logical_2": "Endoscopy (procedure)"}, "relation": "logical_1 and logical_2", "value_out": True},
    {"name": "logical_4", "lf_in": {"logical_1": "Biopsy (procedure)", "lf_folded": None}, "relation": "logical_1 or lf_folded", "value_out": True},
]
VOTED = f"""SELECT p.span_id, p.note_id, p.label, p.start, p."end",
  CASE WHEN regexp_matches(string_agg(t.sentence, '') FILTER (t.sentence_id = p.sentence_id), '{TERM % "the|und|e-mail"}') THEN 'Biopsy (procedure)' END AS lf_terms,
  CASE WHEN regexp_matches(lower(translate(string_agg(t.sentence, '' ORDER BY t.sentence_id) FILTER (t.sentence_id >= p.sentence_id), '{ad._FROM}', '{ad._TO}')), '[0-9]{{2,}}|ing (?:on|of)') THEN 'Imaging (procedure)' END AS lf_regex,
  CASE WHEN regexp_matches(lower(translate(string_agg(t.sentence, '' ORDER BY t.sentence_id) FILTER (t.sentence_id <= p.sentence_id), '{ad._FROM}', '{ad._TO}')), '{TERM % "des|fur|que"}') THEN 'Endoscopy (procedure)' END AS lf_folded
  FROM placed p JOIN sentence_row t ON t.note_id = p.note_id AND t.sentence_id BETWEEN p.sentence_id - 1 AND p.sentence_id + 1 GROUP BY ALL"""
LOGIC = """SELECT *, CASE WHEN logical_1 AND logical_2 IS NOT NULL THEN true END AS logical_3, CASE WHEN lf_folded IS NULL THEN true END AS logical_4 FROM
  (SELECT *, CASE WHEN lf_terms IS NOT NULL AND lf_regex IS NOT NULL THEN true END AS logical_1,
     CASE WHEN lf_terms IS NULL OR lf_folded IS NOT NULL THEN 'Endoscopy (procedure)' END AS logical_2 FROM voted)"""
VOTE_CTES = {"sentence_row": SENTENCE_ROWS, "placed": PLACED, "voted": VOTED, "logic": LOGIC}


def voted_spans(spark, d):
    return _pattern_votes(spark, d, [LF_TERMS, LF_REGEX, LF_FOLDED])


@query(
    "lf_logical",
    with_ctes("SELECT span_id, logical_1, logical_2, logical_3, logical_4 FROM logic", "span", **VOTE_CTES),
)
def lf_logical(spark, d):
    return lfs.logical_lfs(voted_spans(spark, d), LOGICAL_RULES).select("span_id", "logical_1", "logical_2", "logical_3", "logical_4")


@query(
    "lf_rule_baseline",
    with_ctes(
        """SELECT note_id, start, "end", label, CASE WHEN lf_terms IS NULL THEN '0' ELSE '1' END AS biopsy_procedure, CASE WHEN lf_folded IS NULL THEN '0' ELSE '1' END AS endoscopy_procedure FROM voted""",
        "span",
        **VOTE_CTES,
    ),
)
def lf_rule_baseline(spark, d):
    return lb.rule_baseline(voted_spans(spark, d), {"lf_terms": "Biopsy (procedure)", "lf_folded": "Endoscopy (procedure)"})


@query(
    "cp_apply_lfs",
    with_ctes(
        """SELECT span_id, lf_terms, lf_regex, logical_1, logical_3, lf_ccam, lf_imaging_md FROM logic JOIN (
          SELECT s.span_id, string_agg(DISTINCT class, '|' ORDER BY class) FILTER (lf = 'lf_ccam') AS lf_ccam, string_agg(DISTINCT class, '|' ORDER BY class) FILTER (lf = 'lf_imaging_md') AS lf_imaging_md
          FROM span s LEFT JOIN knowledge k ON k.person_id = s.person_id AND k.event_date = s.note_date
          WHERE s.person_id IN (SELECT person_id FROM knowledge) GROUP BY 1) USING (span_id)""",
        "span",
        "knowledge",
        **VOTE_CTES,
    ),
)
def cp_apply_lfs(spark, d):
    rows = lb.apply_lfs(
        ad.notes(spark, d), ad.knowledge_rows(spark, d), [LF_TERMS, LF_REGEX, LF_FOLDED], LOGICAL_RULES, ad.SPAN_PATTERNS,
        knowledge_lfs=["lf_ccam", "lf_imaging_md"], span_date=F.col("note_date"), keys=("note_id", "person_id", "note_date"),
    )
    return rows.select(
        "span_id", "lf_terms", "lf_regex", "logical_1", "logical_3", F.array_join("lf_ccam", "|").alias("lf_ccam"),
        F.array_join("lf_imaging_md", "|").alias("lf_imaging_md"),
    )


@query(
    "j_merge_votes",
    with_ctes(
        """SELECT a.note_id, a.start, a."end", a.label, a.lf_terms, b.lf_regex FROM voted a LEFT JOIN (SELECT * FROM voted WHERE label = 'number') b
        ON a.note_id = b.note_id AND a.start = b.start AND a."end" = b."end" WHERE a.label <> 'email'""",
        "span",
        **VOTE_CTES,
    ),
)
def j_merge_votes(spark, d):
    votes = voted_spans(spark, d)
    first = votes.filter("label <> 'email'").select("note_id", "start", "end", "label", "lf_terms")
    second = votes.filter("label = 'number'").select("note_id", "start", "end", "label", "lf_regex")
    return lfs.merge_votes([first, second])


# ---------------------------------------------------------------- prompts

PROMPTS = {
    "0": {
        "system_prompt": "Answer with {{'{snomed_short_name}':bool}} for {unknown}.",
        "prefix_prompt": "<<<\n",
        "suffix_prompt": "\n>>>\nIs '{span}' a {snomed_short_name} date?",
        "examples": [("12/03", "seen on 12/03", "yes"), ("7", "7 beds", "no")],
    },
    "1": {"system_prompt": "Find {attribute}.", "prefix_prompt": "[", "suffix_prompt": "] {span}?"},
}


def _asked(spark, d):
    """Every span, with the 75 words before and behind it, and the prompts of every task."""
    return ad.spans(spark, d, {"context": sp.ContextWindow(words=(75, 75))}), lfs.prompt_rows(spark, PROMPTS, ad.tasks(spark, d), {6: "1"})


PROMPT_CONTEXT = """SELECT p.span_id, string_agg(w.piece, '' ORDER BY w.word_id) AS context FROM word_at p
  JOIN word_row w ON w.note_id = p.note_id AND w.word_id BETWEEN p.word_id - 75 AND p.word_id + 75 GROUP BY p.span_id"""
PROMPT_SQL = """SELECT span_id, task_id, CASE WHEN task_id = 6 THEN 'Find ' || normalized_task_name || '.' ELSE 'Answer with {''' || snomed_short_name || ''':bool} for {unknown}.' END AS system_prompt,
  CASE WHEN task_id = 6 THEN '[' || context || '] ' || lexical_variant || '?' ELSE '<<<' || chr(10) || context || chr(10) || '>>>' || chr(10) || 'Is ''' || lexical_variant || ''' a ' || snomed_short_name || ' date?' END AS prompt,
  CASE WHEN task_id = 6 THEN '' ELSE '<<<' || chr(10) || 'seen on 12/03' || chr(10) || '>>>' || chr(10) || 'Is ''12/03'' a ' || snomed_short_name || ' date?=yes|<<<' || chr(10) || '7 beds' || chr(10) || '>>>' || chr(10) || 'Is ''7'' a ' || snomed_short_name || ' date?=no' END AS examples
  FROM span JOIN prompt_context USING (span_id) JOIN task ON true"""
PROMPT_CTES = {"word_row": WORDS, "word_at": WORD_AT, "prompt_context": PROMPT_CONTEXT, "prompt_row": PROMPT_SQL}


@query("sc_build_prompts", with_ctes("SELECT span_id, task_id, system_prompt, examples, md5(prompt) AS prompt FROM prompt_row", "span", "task", **PROMPT_CTES))
def sc_build_prompts(spark, d):
    examples = F.array_join(F.transform("examples", lambda e: F.concat_ws("=", e["prompt"], e["answer"])), "|")
    return lfs.build_prompts(*_asked(spark, d)).select("span_id", "task_id", "system_prompt", examples.alias("examples"), F.md5("prompt").alias("prompt"))


def answer_by_length(asked: pd.DataFrame) -> pd.Series:
    """Stand-in for a model: a JSON answer from the length of the prompt."""

    def even_or_odd(system):
        name = re.search("'([^']+)'", system or "")
        return [f'{{"{name[1] if name else "none"}":{value}}}' for value in ("true", "false")]

    systems, prompts = asked["system_prompt"].tolist(), asked["prompt"].tolist()
    answers = {system: even_or_odd(system) for system in set(systems)}
    return pd.Series([answers[system][prompt is None or len(prompt) % 2] for system, prompt in zip(systems, prompts)], asked.index, object)


@query(
    "lf_batch_scorer",
    with_ctes("SELECT span_id, task_id, CASE WHEN task_id <> 6 THEN length(prompt) % 2 = 0 END AS vote FROM prompt_row", "span", "task", **PROMPT_CTES),
)
def lf_batch_scorer(spark, d):
    scored = lfs.score_spans_by_prompts(*_asked(spark, d), answer_by_length, rows=2000, in_flight=2)
    return lfs.parse_votes(scored).select("span_id", "task_id", "vote")


@query(
    "sc_parse_json_vote",
    "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN true ELSE false END AS vote FROM events",
)
def sc_parse_json_vote(spark, d):
    big = F.get_json_object("props", "$.k").cast("int") > 50
    answers = ad.table(spark, d, "events").select("event_id", F.to_json(F.create_map("event_type", big)).alias("answer"), "event_type")
    return lfs.parse_votes(answers, field_name="event_type").select("event_id", "vote")


@query(
    "sc_match_vote",
    with_ctes(f"SELECT span_id, coalesce(lf_marks = '{ad.TASK}', false) AS marks, coalesce(list_contains(lf_lang, '{ad.TASK}'), false) AS lang, coalesce(lf_short, false) AS short FROM vote", "vote"),
)
def sc_match_vote(spark, d):
    votes = ad.document_votes(spark, d)
    columns = {"marks": "lf_marks", "lang": "lf_lang", "short": "lf_short"}
    return votes.select("span_id", *[lfs.match_vote(F.col(c), votes.schema[c].dataType, ad.TASK).alias(n) for n, c in columns.items()])
