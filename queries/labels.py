"""Queries over label matrices, label models, annotations, metrics and agreement."""

from pyspark.sql import functions as F

from clinspark.operators import annotations as an, evaluation as evl, label_models as lm, lfs
from clinspark.plans import labelling as lb
from queries import adapters as ad
from queries.adapters import TASK, VOTES, with_ctes
from queries.registry import query

CODES = dict(negative=1, positive=2, abstention=0)
FILL = ["lf_digit"]


def matrix(spark, d, **options):
    return lm.label_matrix(ad.document_votes(spark, d), TASK, VOTES, fill_negative=FILL, **CODES, **options)


ALL_ABSTAIN = f"""SELECT note_id, bool_and(lf_marks IS NULL AND lf_digit IS NULL AND lf_short IS NULL AND NOT coalesce(list_contains(lf_lang, '{TASK}'), false) AND lf_mail IS NULL) AS all_abstain FROM vote GROUP BY 1"""


@query("lm_label_matrix", with_ctes("SELECT span_id, lf_marks, lf_digit, lf_short, lf_lang, lf_mail FROM matrix JOIN abstaining USING (note_id) WHERE NOT all_abstain", "matrix", abstaining=ALL_ABSTAIN))
def lm_label_matrix(spark, d):
    return matrix(spark, d, drop_all_abstaining=True).select("span_id", *VOTES)


@query(
    "a_all_abstain",
    with_ctes("SELECT span_id, all_abstain FROM vote JOIN (SELECT note_id, bool_and(lf_marks IS NULL AND lf_digit IS NULL) AS all_abstain FROM vote GROUP BY 1) USING (note_id)", "vote"),
)
def a_all_abstain(spark, d):
    return lfs.has_any_vote(ad.document_votes(spark, d), ["lf_marks", "lf_digit"]).select("span_id", "all_abstain")


def _count(code):
    return "(" + " + ".join(f"CASE WHEN {lf} = {code} THEN 1 ELSE 0 END" for lf in VOTES) + ")"


MAJORITY = f"""SELECT *, CASE WHEN k1 >= k2 THEN 1.0 ELSE 0.0 END / (CASE WHEN k1 = k2 THEN 2 ELSE 1 END) AS p0, CASE WHEN k2 >= k1 THEN 1.0 ELSE 0.0 END / (CASE WHEN k1 = k2 THEN 2 ELSE 1 END) AS p1
  FROM (SELECT *, {_count(1)} AS k1, {_count(2)} AS k2 FROM matrix)"""


@query("lm_majority_probs", with_ctes("SELECT span_id, CAST(p0 AS DOUBLE) AS prob_0, CAST(p1 AS DOUBLE) AS prob_1 FROM maj", "matrix", maj=MAJORITY))
def lm_majority_probs(spark, d):
    return lm.majority_vote(matrix(spark, d), VOTES, classes=(1, 2), abstention=0).select("span_id", "prob_0", "prob_1")


@query(
    "lm_majority_label",
    with_ctes(
        "SELECT span_id, CAST(CASE WHEN k1 > k2 THEN 1 WHEN k2 > k1 THEN 2 ELSE 1 + ('0x' || substr(md5('7|' || span_id), 1, 15))::BIGINT % 2 END AS INTEGER) AS label_majority FROM maj", "matrix", maj=MAJORITY
    ),
)
def lm_majority_label(spark, d):
    probs = lm.majority_vote(matrix(spark, d), VOTES, classes=(1, 2), abstention=0)
    return lm.majority_label(probs, ["span_id"], classes=(1, 2), seed=7).select("span_id", "label_majority")


def _sign(lf):
    return f"CASE {lf} WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END"


MOMENTS = (
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, CAST(sum(({_sign(a)}) * ({_sign(b)})) AS DOUBLE) / nullif(sum(abs(({_sign(a)}) * ({_sign(b)}))), 0) AS m FROM matrix"
        for a in VOTES
        for b in VOTES
        if a != b
    )
    + ") WHERE m IS NOT NULL"
)
FIT = f"""SELECT n.lf, least(greatest(coalesce(a, 0.5), 0.05), 0.95) AS accuracy FROM (SELECT unnest({VOTES}) AS lf) n LEFT JOIN (
  SELECT ij.i AS lf, median(sqrt(abs(ij.m * ik.m / jk.m))) AS a FROM moment ij JOIN moment ik ON ij.i = ik.i AND ij.j < ik.j JOIN moment jk ON jk.i = ij.j AND jk.j = ik.j
  WHERE jk.m <> 0 GROUP BY 1) f ON f.lf = n.lf"""


@query("lm_triplet_fit", with_ctes("SELECT lf, round(accuracy, 6) AS accuracy FROM fit", "matrix", moment=MOMENTS, fit=FIT))
def lm_triplet_fit(spark, d):
    return lm.triplet_fit(matrix(spark, d), VOTES, 1, 2).select("lf", F.round("accuracy", 6).alias("accuracy"))


def _em_sql() -> str:
    """Rounds of expectation-maximisation on counted patterns, one row per round, until no accuracy moves by the tolerance."""
    signs = {lf: f"s_{lf}" for lf in VOTES}
    odds = " + ".join(f"{signs[lf]} * ln((1 + a_{lf}) / (1 - a_{lf}))" for lf in VOTES)
    rates = [
        f"least(greatest(2 * (sum(CASE {signs[lf]} WHEN 1 THEN n * p WHEN -1 THEN n * (1 - p) ELSE 0 END) + 1) / (sum(n * abs({signs[lf]})) + 2) - 1, -0.95), 0.95) AS a_{lf}"
        for lf in VOTES
    ]
    return f"""WITH RECURSIVE {{ctes}}, pattern AS (SELECT {', '.join(f"{_sign(lf)} AS {signs[lf]}" for lf in VOTES)}, count(*) AS n FROM matrix GROUP BY ALL),
      round AS (
        SELECT 0 AS k, {', '.join(f'0.4::DOUBLE AS a_{lf}' for lf in VOTES)}, 1.0::DOUBLE AS moved
        UNION ALL
        SELECT k, {', '.join(f'a_{lf}' for lf in VOTES)}, greatest({', '.join(f'abs(a_{lf} - o_{lf})' for lf in VOTES)}) AS moved FROM (
          SELECT max(k) + 1 AS k, {', '.join(rates)}, {', '.join(f'max(a_{lf}) AS o_{lf}' for lf in VOTES)}
          FROM (SELECT *, 1 / (1 + exp(-(ln(0.1 / 0.9) + {odds}))) AS p FROM round, pattern WHERE k < 30 AND moved >= 0.0001) HAVING max(k) IS NOT NULL)
      ), last AS (SELECT * FROM round ORDER BY k DESC LIMIT 1)
      SELECT lf, round(a, 6) AS accuracy, round((1 + a) / 2, 6) AS correct_rate FROM (
        {' UNION ALL '.join(f"SELECT '{lf}' AS lf, a_{lf} AS a FROM last" for lf in VOTES)})"""


@query("lm_em_fit", _em_sql().replace("{ctes}", with_ctes("", "matrix").strip().removeprefix("WITH ").rstrip()))
def lm_em_fit(spark, d):
    return _rounded(lm.em_fit(matrix(spark, d), VOTES, 0.1, 1, 2))


def _odds(lf):
    return f"({_sign(lf)}) * (SELECT ln((1 + accuracy) / (1 - accuracy)) FROM fit WHERE lf = '{lf}')"


POSTERIOR = f"SELECT span_id, 1 / (1 + exp(-(ln(0.1 / 0.9) + {' + '.join(_odds(lf) for lf in VOTES)}))) AS p1 FROM matrix"


@query("lm_posterior", with_ctes("SELECT span_id, round(p1, 6) AS prob_1, round(1 - p1, 6) AS prob_0 FROM post", "matrix", moment=MOMENTS, fit=FIT, post=POSTERIOR))
def lm_posterior(spark, d):
    votes = matrix(spark, d)
    probs = lm.predict_probs(votes, lm.triplet_fit(votes, VOTES, 1, 2), 0.1, 1, 2)
    return probs.select("span_id", F.round("prob_1", 6).alias("prob_1"), F.round("prob_0", 6).alias("prob_0"))


def _summary_sql(gold: bool) -> str:
    parts = []
    for lf in VOTES:
        others = [o for o in VOTES if o != lf]
        voted = " OR ".join(f"{o} <> 0" for o in others)
        differs = " OR ".join(f"({o} <> 0 AND {o} <> {lf})" for o in others)
        extra = ""
        if gold:
            extra = f""", count(*) FILTER ({lf} <> 0 AND {lf} = gold) AS correct, count(*) FILTER ({lf} <> 0 AND {lf} <> gold) AS incorrect,
              round(CAST(count(*) FILTER ({lf} <> 0 AND {lf} = gold) AS DOUBLE) / nullif(count(*) FILTER ({lf} <> 0), 0), 6) AS accuracy"""
        parts.append(
            f"""SELECT '{lf}' AS lf, coalesce(string_agg(DISTINCT CAST({lf} AS VARCHAR), '|' ORDER BY CAST({lf} AS VARCHAR)) FILTER ({lf} <> 0), '') AS polarity,
            round(CAST(count(*) FILTER ({lf} <> 0) AS DOUBLE) / count(*), 6) AS coverage, round(CAST(count(*) FILTER ({lf} <> 0 AND ({voted})) AS DOUBLE) / count(*), 6) AS overlaps,
            round(CAST(count(*) FILTER ({lf} <> 0 AND ({differs})) AS DOUBLE) / count(*), 6) AS conflicts{extra} FROM {'known' if gold else 'matrix'}"""
        )
    return " UNION ALL ".join(parts)


KNOWN = "SELECT m.*, CASE WHEN quality = 0 THEN 2 ELSE 1 END AS gold FROM matrix m LEFT JOIN labels ON doc_id = span_id"


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("lf_summary", with_ctes(_summary_sql(True), "matrix", known=KNOWN))
def lf_summary(spark, d):
    gold = ad.gold(spark, d).select("span_id", F.when(F.col("quality") == 0, 2).otherwise(1).alias("gold"))
    votes = matrix(spark, d).join(gold, "span_id", "left").fillna({"gold": 1})
    return _rounded(lm.lf_summary(votes, VOTES, 0, "gold"))


@query("lf_summary_train", with_ctes(_summary_sql(False), "matrix"))
def lf_summary_train(spark, d):
    return _rounded(lm.lf_summary(matrix(spark, d), VOTES, 0))


@query(
    "j_votes_gold",
    with_ctes("SELECT span_id, CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS ground_truth_label FROM vote LEFT JOIN labels ON doc_id = span_id", "vote"),
)
def j_votes_gold(spark, d):
    votes = ad.document_votes(spark, d).select("span_id")
    return lfs.votes_with_gold(votes, ad.gold(spark, d), "toxic", 2, 1, keys=["span_id"])


@query("a_class_balance", "SELECT quality, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 1")
def a_class_balance(spark, d):
    return _rounded(lm.class_balance(ad.gold(spark, d), "quality"))


@query("a_prob_hist", with_ctes("SELECT round(p1, 5) AS prob, count(*) AS n FROM scored GROUP BY 1", "scored"))
def a_prob_hist(spark, d):
    return lm.prob_histogram(ad.scored_spans(spark, d), "biopsy_procedure_1")


@query("a_threshold_counts", with_ctes("SELECT count(*) FILTER (p1 >= 0.5) AS n_positive, count(*) FILTER (p1 < 0.5) AS n_negative FROM scored", "scored"))
def a_threshold_counts(spark, d):
    return lm.threshold_counts(ad.scored_spans(spark, d), "biopsy_procedure_1")


@query(
    "sc_rescale",
    with_ctes("SELECT span_id, round(CASE WHEN mx < 0.5 THEN q / mx ELSE q END, 6) AS p1, round(1 - CASE WHEN mx < 0.5 THEN q / mx ELSE q END, 6) AS p0 FROM (SELECT span_id, p1 / 3 AS q, max(p1 / 3) OVER () AS mx FROM scored)", "scored"),
)
def sc_rescale(spark, d):
    scored = ad.scored_spans(spark, d).select("span_id", (F.col("biopsy_procedure_1") / 3).alias("p1"), F.lit(0.0).alias("p0"))
    return _rounded(lm.rescale_probs(scored, "p1", "p0"))


OTHER = "other task"
LFS_BY_TASK = {TASK: VOTES, OTHER: ["lf_marks", "lf_lang", "lf_short"]}


def _two_task_sql() -> str:
    """Codes of both tasks; functions without a vote are negative unless they vote with arrays."""

    def code(lf, task):
        if lf == "lf_lang":
            return f"CASE WHEN list_contains(lf_lang, '{task}') THEN 2 ELSE 0 END"
        if lf in ("lf_short", "lf_mail"):
            return f"CASE WHEN {lf} THEN 2 ELSE 1 END"
        return f"CASE WHEN {lf} IS NULL THEN 1 WHEN {lf} = '{task}' THEN 2 ELSE 0 END"

    columns = []
    for t, (task, functions) in enumerate(LFS_BY_TASK.items()):
        codes = [code(lf, task) for lf in functions]
        k1 = " + ".join(f"(({c}) = 1)::INTEGER" for c in codes)
        k2 = " + ".join(f"(({c}) = 2)::INTEGER" for c in codes)
        columns.append(f"({k1}) AS n{t}, ({k2}) AS y{t}")
    return f"SELECT span_id, {', '.join(columns)} FROM vote"


@query(
    "lm_tasks",
    with_ctes(
        """SELECT span_id, CAST(a AS DOUBLE) AS low_quality_1, CAST(1 - a AS DOUBLE) AS low_quality_0, CAST(b AS DOUBLE) AS other_task_1, CAST(b AS DOUBLE) AS other_task_map FROM (SELECT span_id, CASE WHEN ma < 0.5 THEN a / ma ELSE a END AS a, CASE WHEN mb < 0.5 THEN b / mb ELSE b END AS b
        FROM (SELECT *, max(a) OVER () AS ma, max(b) OVER () AS mb FROM (SELECT span_id, CASE WHEN y0 > n0 THEN 1.0 WHEN y0 = n0 THEN 0.5 ELSE 0.0 END AS a, CASE WHEN y1 > n1 THEN 1.0 WHEN y1 = n1 THEN 0.5 ELSE 0.0 END AS b FROM counted)))""",
        "vote",
        counted=_two_task_sql(),
    ),
)
def lm_tasks(spark, d):
    rows = lb.label_tasks(ad.document_votes(spark, d), LFS_BY_TASK, "majority", rescale=True, keep=["span_id"])
    return rows.select("span_id", "low_quality_1", "low_quality_0", "other_task_1", F.col("other_task")["1"].alias("other_task_map"))


def _abstaining_code(lf, task):
    if lf == "lf_lang":
        return f"CASE WHEN list_contains(lf_lang, '{task}') THEN 1 ELSE 0 END"
    if lf in ("lf_short", "lf_mail"):
        return f"CASE WHEN {lf} THEN 1 WHEN NOT {lf} THEN -1 ELSE 0 END"
    return f"CASE WHEN {lf} = '{task}' THEN 1 ELSE 0 END"


def _voted(lf, task):
    return f"coalesce(list_contains(lf_lang, '{task}'), false)" if lf == "lf_lang" else f"{lf} IS NOT NULL"


def _triplet_ctes() -> dict[str, str]:
    """Per task: signs, moments on notes with votes, accuracies and posteriors."""
    ctes = {}
    for t, (task, functions) in enumerate(LFS_BY_TASK.items()):
        signs = ", ".join(f"{_abstaining_code(lf, task)} AS s_{lf}" for lf in functions)
        voted = " OR ".join(_voted(lf, task) for lf in functions)
        ctes[f"signed{t}"] = f"SELECT span_id, {signs}, bool_or({voted}) OVER (PARTITION BY note_id) AS kept FROM vote"
        pairs = [(a, b) for a in functions for b in functions if a != b]
        ctes[f"moment{t}"] = (
            "SELECT * FROM ("
            + " UNION ALL ".join(
                f"SELECT '{a}' AS i, '{b}' AS j, CAST(sum(s_{a} * s_{b}) AS DOUBLE) / nullif(sum(abs(s_{a} * s_{b})), 0) AS m FROM signed{t} WHERE kept" for a, b in pairs
            )
            + ") WHERE m IS NOT NULL"
        )
        ctes[f"fit{t}"] = FIT.replace(str(VOTES), str(functions)).replace("moment ", f"moment{t} ")
        odds = " + ".join(f"s_{lf} * (SELECT ln((1 + accuracy) / (1 - accuracy)) FROM fit{t} WHERE lf = '{lf}')" for lf in functions)
        ctes[f"post{t}"] = f"SELECT span_id, 1 / (1 + exp(-(ln(0.1 / 0.9) + {odds}))) AS p FROM signed{t}"
    return ctes


@query(
    "lm_tasks_triplet",
    with_ctes(
        """SELECT a.span_id, round(CASE WHEN max(a.p) OVER () < 0.5 THEN a.p / max(a.p) OVER () ELSE a.p END, 6) AS low_quality_1, round(CASE WHEN max(b.p) OVER () < 0.5 THEN b.p / max(b.p) OVER () ELSE b.p END, 6) AS other_task_1
        FROM post0 a JOIN post1 b ON a.span_id = b.span_id""",
        "vote",
        **_triplet_ctes(),
    ),
)
def lm_tasks_triplet(spark, d):
    rows = lb.label_tasks(ad.document_votes(spark, d), LFS_BY_TASK, "triplet", shares=0.1, fillnone_as_negative=False, rescale=True, keep=["span_id"])
    return rows.select("span_id", F.round("low_quality_1", 6).alias("low_quality_1"), F.round("other_task_1", 6).alias("other_task_1"))


PIPELINE_GOLD = {TASK: "is_low", OTHER: "is_toxic"}


def _pipeline(spark, d):
    """Every document is a training span; those with labels are the dev set."""
    votes = ad.document_votes(spark, d)
    judged = ad.gold(spark, d).select("span_id", (F.col("quality") == 0).alias("is_low"), (F.col("toxic") == 1).alias("is_toxic"))
    return lb.label_pipeline(votes, LFS_BY_TASK, votes.join(judged, "span_id"), PIPELINE_GOLD, "triplet", shares=0.1, fillnone_as_negative=False, keep=["span_id"])


def _pipeline_ctes() -> dict[str, str]:
    """The triplet model of each task with the share of positives of the labelled documents."""
    ctes = _triplet_ctes()
    for t, truth in enumerate(("quality = 0", "toxic = 1")):
        ctes[f"dev{t}"] = f"SELECT s.*, CASE WHEN {truth} THEN 1 ELSE -1 END AS gold FROM signed{t} s JOIN labels ON doc_id = span_id"
        ctes[f"share{t}"] = f"SELECT CASE WHEN k >= 15 AND n > k THEN k / n ELSE 0.1 END AS share FROM (SELECT CAST(count(*) FILTER (gold = 1) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM dev{t})"
        post = ctes.pop(f"post{t}")
        ctes[f"post{t}"] = post.replace("ln(0.1 / 0.9)", f"(SELECT ln(share / (1 - share)) FROM share{t})")
        ctes[f"hit{t}"] = f"SELECT gold, p > 0.5 AS called FROM dev{t} JOIN post{t} USING (span_id)"
    return ctes


def _pipeline_sql() -> str:
    parts = []
    for t, task in enumerate(LFS_BY_TASK):
        parts.append(
            f"""SELECT '{task}' AS task, round(share, 6) AS share, count(*) FILTER (gold = 1) AS support, count(*) AS instances,
            round(coalesce(CAST(count(*) FILTER (called AND gold = 1) AS DOUBLE) / nullif(count(*) FILTER (called), 0), 0), 6) AS precision,
            round(coalesce(CAST(count(*) FILTER (called AND gold = 1) AS DOUBLE) / nullif(count(*) FILTER (gold = 1), 0), 0), 6) AS recall,
            round(coalesce(2.0 * count(*) FILTER (called AND gold = 1) / nullif(count(*) FILTER (called) + count(*) FILTER (gold = 1), 0), 0), 6) AS fscore,
            (SELECT count(*) FROM post{t} WHERE p >= 0.5) AS count_positives, (SELECT count(*) FROM post{t} WHERE p < 0.5) AS count_negatives
            FROM hit{t}, share{t} GROUP BY share"""
        )
    return " UNION ALL ".join(parts)


@query("lm_pipeline", with_ctes(_pipeline_sql(), "vote", **_pipeline_ctes()))
def lm_pipeline(spark, d):
    return _rounded(_pipeline(spark, d).metrics)


@query(
    "lm_pipeline_labels",
    with_ctes("SELECT a.span_id, round(a.p, 6) AS low_quality_1, round(1 - a.p, 6) AS low_quality_0, round(b.p, 6) AS other_task_1 FROM post0 a JOIN post1 b USING (span_id)", "vote", **_pipeline_ctes()),
)
def lm_pipeline_labels(spark, d):
    return _rounded(_pipeline(spark, d).labels.select("span_id", "low_quality_1", "low_quality_0", "other_task_1"))


def _pipeline_summary_sql() -> str:
    parts = []
    for t, (task, functions) in enumerate(LFS_BY_TASK.items()):
        for held, rows in (("train", f"(SELECT *, NULL AS gold FROM signed{t} WHERE kept)"), ("dev", f"dev{t}")):
            for lf in functions:
                s, others = f"s_{lf}", [f"s_{o}" for o in functions if o != lf]
                voted, against = " OR ".join(f"{o} <> 0" for o in others), " OR ".join(f"{o} = -{s}" for o in others)
                judged = f"count(*) FILTER ({s} <> 0 AND {s} = gold)" if held == "dev" else "NULL"
                parts.append(
                    f"""SELECT '{held}' AS held, '{task}' AS task, '{lf}' AS lf, coalesce(string_agg(DISTINCT CASE {s} WHEN 1 THEN '2' ELSE '1' END, '|' ORDER BY CASE {s} WHEN 1 THEN '2' ELSE '1' END) FILTER ({s} <> 0), '') AS polarity,
                    round(CAST(count(*) FILTER ({s} <> 0) AS DOUBLE) / count(*), 6) AS coverage, round(CAST(count(*) FILTER ({s} <> 0 AND ({voted})) AS DOUBLE) / count(*), 6) AS overlaps,
                    round(CAST(count(*) FILTER ({s} <> 0 AND ({against})) AS DOUBLE) / count(*), 6) AS conflicts, CAST({judged} AS BIGINT) AS correct FROM {rows}"""
                )
    return " UNION ALL ".join(parts)


@query("lm_pipeline_summary", with_ctes(_pipeline_summary_sql(), "vote", **_pipeline_ctes()))
def lm_pipeline_summary(spark, d):
    run = _pipeline(spark, d)
    train = run.summary_train.withColumns({"held": F.lit("train"), "correct": F.lit(None).cast("bigint")})
    dev = run.summary_dev.withColumn("held", F.lit("dev"))
    columns = ["held", "task", "lf", "polarity", "coverage", "overlaps", "conflicts", "correct"]
    return _rounded(train.select(*columns).unionByName(dev.select(*columns)))


# ---------------------------------------------------------------- annotations

HIGHLIGHT = """SELECT note_id, lexical_variant AS label, greatest(start - 12, 0) AS "begin", "end" + 15 AS "end" FROM span WHERE label = 'word'"""
OVERLAP = """SELECT DISTINCT s.note_id, s.start AS "begin", s."end", h.label FROM span s JOIN highlight h ON h.note_id = s.note_id AND h."begin" <= s."end" AND s.start <= h."end" WHERE s.label <> 'word'"""


def _annotated(spark, d):
    spans = ad.spans(spark, d)
    dates = spans.filter("label <> 'word'").select("note_id", F.col("start").alias("begin"), "end", "label", "lexical_variant")
    highlights = spans.filter("label = 'word'").select(
        "note_id", F.col("lexical_variant").alias("label"), F.greatest(F.col("start") - 12, F.lit(0)).alias("begin"), (F.col("end") + 15).alias("end")
    )
    return dates, highlights


@query("j_span_overlap", with_ctes("SELECT * FROM overlap", "span", highlight=HIGHLIGHT, overlap=OVERLAP))
def j_span_overlap(spark, d):
    dates, highlights = _annotated(spark, d)
    return an.overlap_spans(highlights, dates)


LABELS = ["the", "und", "les", "que", "never"]
PIVOT = 'SELECT note_id, "begin", "end", ' + ", ".join(f"coalesce(bool_or(label = '{x}'), false) AS l_{x}" for x in LABELS) + " FROM overlap GROUP BY ALL"


@query("a_pivot_labels", with_ctes("SELECT * FROM pivoted", "span", highlight=HIGHLIGHT, overlap=OVERLAP, pivoted=PIVOT))
def a_pivot_labels(spark, d):
    dates, highlights = _annotated(spark, d)
    flags = an.pivot_labels(an.overlap_spans(highlights, dates), LABELS)
    return flags.withColumnsRenamed({x: f"l_{x}" for x in LABELS})


RULES = [(["les", "que"], "french"), (["french", "und"], "foreign"), (["foreign", "the"], "never")]


@query(
    "so_propagate",
    with_ctes(
        """SELECT note_id, "begin", "end", l_les OR l_que AS french, l_les OR l_que OR l_und AS "foreign", l_never OR l_les OR l_que OR l_und OR l_the AS never FROM pivoted""",
        "span",
        highlight=HIGHLIGHT,
        overlap=OVERLAP,
        pivoted=PIVOT,
    ),
)
def so_propagate(spark, d):
    dates, highlights = _annotated(spark, d)
    flags = an.pivot_labels(an.overlap_spans(highlights, dates), [*LABELS, "french", "foreign"])
    return an.propagate_labels(flags, RULES).select("note_id", "begin", "end", "french", "foreign", "never")


@query(
    "so_replicate",
    with_ctes(
        """SELECT note_id, "begin", "end", label, min(rank) AS copy FROM (SELECT note_id, start AS "begin", "end", label, 0 AS rank FROM span
        UNION ALL SELECT note_id, start, "end", 'token', 1 FROM span WHERE label IN ('number', 'word') UNION ALL SELECT note_id, start, "end", 'token', 0 FROM span WHERE label = 'email') GROUP BY ALL""",
        "span",
    ),
)
def so_replicate(spark, d):
    spans = ad.spans(spark, d).select("note_id", F.col("start").alias("begin"), "end", "label", F.col("span_id").alias("id"))
    known = spans.unionByName(spans.filter("label = 'email'").withColumn("label", F.lit("token")))
    rows = an.replicate_labels(known, ["number", "word"], "token")
    return rows.select("note_id", "begin", "end", "label", F.when(F.col("id").startswith("replicated"), 1).otherwise(0).alias("copy"))


ANNOTATED = """SELECT note_id, annotator, start AS "begin", "end", label FROM (SELECT *, unnest(CASE WHEN source IN ('src1', 'src2', 'src3') THEN ['anna', 'zoe'] WHEN source IN ('src4', 'src5') THEN ['bob', 'carl'] ELSE ['carl'] END) AS annotator
  FROM span JOIN note USING (note_id)) WHERE NOT (annotator = 'zoe' AND label = 'word')"""


def _snapshots(spark, d):
    annotators = (
        F.when(F.col("source").isin("src1", "src2", "src3"), F.array(F.lit("anna"), F.lit("zoe")))
        .when(F.col("source").isin("src4", "src5"), F.array(F.lit("bob"), F.lit("carl")))
        .otherwise(F.array(F.lit("carl")))
    )
    documents = ad.notes(spark, d).select("note_id", "note_text", F.explode(annotators).alias("annotator"))
    spans = ad.spans(spark, d).select("note_id", "span_id", "lexical_variant", F.col("start").alias("begin"), "end", "label")
    entities = documents.join(spans, "note_id").filter("not (annotator = 'zoe' and label = 'word')")
    entities = entities.withColumnsRenamed({"span_id": "id", "lexical_variant": "text"})
    return documents, entities


@query(
    "w_annotator_priority",
    with_ctes(
        """SELECT note_id, annotator FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY CASE annotator WHEN 'zoe' THEN 0 WHEN 'bob' THEN 1 ELSE 2 END, annotator) AS rn
        FROM (SELECT note_id, unnest(CASE WHEN source IN ('src1', 'src2', 'src3') THEN ['anna', 'zoe'] WHEN source IN ('src4', 'src5') THEN ['bob', 'carl'] ELSE ['carl'] END) AS annotator FROM note)) WHERE rn = 1""",
        "note",
    ),
)
def w_annotator_priority(spark, d):
    documents, _ = _snapshots(spark, d)
    return an.prefer_annotator(documents, ["zoe", "bob"]).select("note_id", "annotator")


@query(
    "a_annotators",
    "SELECT doc_id AS note_id, CASE WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN 2 ELSE 1 END::BIGINT AS n_annotators FROM documents",
)
def a_annotators(spark, d):
    return an.annotators_per_note(_snapshots(spark, d)[0])


PROCESSED = """SELECT a.note_id, a.start, a."end", a.label, a.annotator, CASE WHEN bool_or(h.lv = 'the') THEN '1' ELSE '0' END AS the_procedure, CASE WHEN bool_or(h.lv IN ('les', 'que')) THEN '1' ELSE '0' END AS french_procedure FROM
  (SELECT e.* FROM seen e) a LEFT JOIN (SELECT * FROM seen WHERE label = 'word') h ON h.note_id = a.note_id AND h.start <= a."end" + 0 AND a.start <= h."end" WHERE a.label <> 'word' GROUP BY ALL"""
SEEN = """SELECT s.note_id, CASE WHEN s.label = 'word' THEN greatest(s.start - 12, 0) ELSE s.start END AS start, CASE WHEN s.label = 'word' THEN s."end" + 15 ELSE s."end" END AS "end", s.label, s.lexical_variant AS lv, annotator
  FROM span s JOIN (SELECT note_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'zoe' WHEN source IN ('src4', 'src5') THEN 'bob' ELSE 'carl' END AS annotator FROM note) n ON n.note_id = s.note_id
  WHERE NOT (annotator = 'zoe' AND s.label = 'word')"""


@query(
    "cp_annotations",
    with_ctes(f'SELECT note_id, start, "end", label, annotator, the_procedure, french_procedure FROM ({PROCESSED})', "span", seen=SEEN),
)
def cp_annotations(spark, d):
    documents, entities = _snapshots(spark, d)
    wide = F.col("label") == "word"
    entities = entities.select(
        "note_id", "note_text", "annotator", "id", "text",
        F.when(wide, F.col("text")).otherwise(F.col("label")).alias("label"),
        F.when(wide, F.greatest(F.col("begin") - 12, F.lit(0))).otherwise(F.col("begin")).alias("begin"),
        F.when(wide, F.col("end") + 15).otherwise(F.col("end")).alias("end"),
    )
    names = {"the": "the_procedure", "les": "les_procedure", "que": "que_procedure", "french": "french_procedure"}
    rows = an.process_annotations(
        documents, entities, names, [(["les", "que"], "french")], priority=["zoe", "bob"], date_labels=["number", "email"]
    )
    return rows.select("note_id", "start", "end", "label", "annotator", "the_procedure", "french_procedure")


@query(
    "src_annotated_entities",
    with_ctes(
        """SELECT e.note_id, e.start, e."end", t.task_fr AS ground_truth_task_label, t.task_id AS ground_truth_task_id
        FROM (SELECT *, 'Acte NATION_' || length(lexical_variant) AS label_label, CAST(note_id % 3 AS INTEGER) AS screening_group FROM span) e JOIN task t ON t.task_fr = e.label_label WHERE screening_group = 1""",
        "span",
        "task",
    ),
)
def src_annotated_entities(spark, d):
    group = (F.col("note_id") % 3).cast("int").alias("screening_group")
    docs = ad.notes(spark, d).select("note_id", group, (F.col("n_chars") > 100).alias("seen"))
    spans = ad.spans(spark, d).select(
        "note_id", F.col("start").alias("begin_date"), F.col("end").alias("end_date"), group,
        F.concat(F.lit("Acte NATION_"), F.length("lexical_variant").cast("string")).alias("label_label"),
    )
    return an.annotated_entities(docs, spans, ad.tasks(spark, d), 1)[0]


# ---------------------------------------------------------------- metrics and agreement

KEYS = 'note_id, start, "end", label'
PAIRS = """SELECT coalesce(g.note_id, p.note_id) AS note_id, g.bad AS bad_gold, p.bad AS bad_pred, g.toxic AS toxic_gold, p.toxic AS toxic_pred FROM gold_span g FULL JOIN pred_span p ON g.note_id = p.note_id"""


@query("j_gold_pred", with_ctes("SELECT note_id, bad_gold, bad_pred, toxic_gold, toxic_pred FROM paired", "gold_span", "pred_span", paired=PAIRS))
def j_gold_pred(spark, d):
    rows = evl.join_gold_pred(ad.gold_spans(spark, d), ad.predicted_spans(spark, d), ["bad", "toxic"])
    return rows.select("note_id", "bad_gold", "bad_pred", "toxic_gold", "toxic_pred")


def prf_sql(source: str, tasks=("bad", "toxic"), extra: str = "") -> str:
    parts = []
    for t in tasks:
        for c, other in (("0", "1"), ("1", "0")):
            parts.append(
                f"""SELECT {extra}'{t}' AS task, '{c}' AS class, CASE WHEN sup = 0 OR tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN sup = 0 OR tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 6) END AS recall,
                CASE WHEN sup = 0 OR 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS fscore, CAST(CASE WHEN sup = 0 THEN 0 ELSE tp + fn END AS BIGINT) AS support, n_instances
                FROM (SELECT CAST(count(*) FILTER (g = '{c}' AND p = '{c}') AS DOUBLE) AS tp, CAST(count(*) FILTER (g <> '{c}' AND p = '{c}') AS DOUBLE) AS fp, CAST(count(*) FILTER (g = '{c}' AND p <> '{c}') AS DOUBLE) AS fn,
                count({t}_gold) AS n_instances, count(*) FILTER ({t}_gold = '1') AS sup FROM (SELECT {t}_gold, coalesce({t}_gold, '0') AS g, coalesce({t}_pred, '0') AS p FROM {source}))"""
            )
    return " UNION ALL ".join(parts)


@query("metrics_prf", with_ctes(prf_sql("paired"), "gold_span", "pred_span", paired=PAIRS))
def metrics_prf(spark, d):
    return _rounded(evl.evaluate(ad.gold_spans(spark, d), ad.predicted_spans(spark, d), ["bad", "toxic"]))


MANY = {
    "paired_a": """SELECT g.bad AS bad_gold, p.bad AS bad_pred, g.toxic AS toxic_gold, p.toxic AS toxic_pred FROM (SELECT * FROM gold_span WHERE note_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) g JOIN pred_span p ON g.note_id = p.note_id""",
    "paired_b": """SELECT g.bad AS bad_gold, p.toxic AS bad_pred, g.toxic AS toxic_gold, p.bad AS toxic_pred FROM (SELECT * FROM gold_span WHERE note_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')) g JOIN pred_span p ON g.note_id = p.note_id""",
}


@query(
    "cp_evaluate_all",
    with_ctes(
        prf_sql("paired_a", extra="'rules' AS model, 'A' AS dataset, ") + " UNION ALL " + prf_sql("paired_b", extra="'swapped' AS model, 'B' AS dataset, "), "gold_span", "pred_span", **MANY
    ),
)
def cp_evaluate_all(spark, d):
    lang = ad.table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "lang")
    gold = ad.gold_spans(spark, d).join(lang, "note_id")
    gold_sets = {"A": gold.filter("lang = 'en'").drop("lang"), "B": gold.filter("lang <> 'en'").drop("lang")}
    pred = ad.predicted_spans(spark, d)
    swapped = pred.withColumnsRenamed({"bad": "toxic_llm", "toxic": "bad_llm"})
    sets = {("rules", "A"): (pred, None), ("swapped", "B"): (swapped, "llm")}
    return _rounded(evl.evaluate_many(gold_sets, sets, ["bad", "toxic"])[0])


AGREE = """SELECT coalesce(a.bad, '0') AS bad_a, coalesce(b.bad, '0') AS bad_b, coalesce(a.toxic, '0') AS toxic_a, coalesce(b.toxic, '0') AS toxic_b, coalesce(a.note_id, b.note_id) AS note_id
  FROM gold_span a JOIN pred_span b ON a.note_id = b.note_id"""


def _pairs(spark, d):
    keys = ["note_id", "start", "end", "label"]
    return evl.paired_annotations(ad.gold_spans(spark, d), ad.predicted_spans(spark, d), ["bad", "toxic"], keys)


def _kappa_sql(t):
    return f"""SELECT '{t}' AS task, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN 2 * yy + yn + ny > 0 THEN 2 * yy / (2 * yy + yn + ny) ELSE 0.0 END, 6) AS f1,
      CAST(yn + ny AS BIGINT) AS n_discordances, CAST(yy + yn AS BIGINT) AS n_positive_a, CAST(yy + ny AS BIGINT) AS n_positive_b
      FROM (SELECT *, (yy + nn) / n AS po, ((yy + yn) * (yy + ny) + (nn + yn) * (nn + ny)) / (n * n) AS pe FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ({t}_a = '1' AND {t}_b = '1') AS DOUBLE) AS yy,
      CAST(count(*) FILTER ({t}_a = '1' AND {t}_b <> '1') AS DOUBLE) AS yn, CAST(count(*) FILTER ({t}_a <> '1' AND {t}_b = '1') AS DOUBLE) AS ny, CAST(count(*) FILTER ({t}_a <> '1' AND {t}_b <> '1') AS DOUBLE) AS nn FROM agree))"""


@query("kappa", with_ctes(_kappa_sql("bad") + " UNION ALL " + _kappa_sql("toxic"), "gold_span", "pred_span", agree=AGREE))
def kappa(spark, d):
    return _rounded(evl.agreement(_pairs(spark, d), ["bad", "toxic"]))


@query(
    "discordances",
    with_ctes(
        "SELECT note_id, 'bad' AS task, bad_a AS label_a, bad_b AS label_b FROM agree WHERE bad_a <> bad_b UNION ALL SELECT note_id, 'toxic', toxic_a, toxic_b FROM agree WHERE toxic_a <> toxic_b",
        "gold_span",
        "pred_span",
        agree=AGREE,
    ),
)
def discordances(spark, d):
    return evl.discordances(_pairs(spark, d), ["bad", "toxic"], ["note_id"])


@query(
    "a_task_stats",
    with_ctes("SELECT 1 AS task_id, 'bad' AS task, count(*) FILTER (bad = '0') AS n_0, count(*) FILTER (bad = '1') AS n_1 FROM gold_span UNION ALL SELECT 2, 'toxic', count(*) FILTER (toxic = '0'), count(*) FILTER (toxic = '1') FROM gold_span", "gold_span"),
)
def a_task_stats(spark, d):
    return evl.task_stats(ad.gold_spans(spark, d), ["bad", "toxic"])


def _quality_sql() -> str:
    signs = " + ".join(f"({_abstaining_code(lf, TASK)})" for lf in VOTES)
    return f"SELECT CASE WHEN quality = 0 THEN '1' ELSE '0' END AS bad_gold, CASE WHEN {signs} > 0 THEN '1' ELSE '0' END AS bad_pred FROM vote JOIN labels ON doc_id = span_id"


@query("lm_quality_metrics", with_ctes(prf_sql("judged", ["bad"]), "vote", judged=_quality_sql()))
def lm_quality_metrics(spark, d):
    """Documents -> votes -> majority labels -> precision and recall against the gold labels."""
    votes = ad.document_votes(spark, d)
    probs = lb.label_tasks(votes, {TASK: VOTES}, "majority", fillnone_as_negative=False, rescale=False, keep=["span_id"])
    flag = F.when(F.col("low_quality_1") > 0.5, "1").otherwise("0")
    pred = probs.select(F.col("span_id").alias("note_id"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("doc").alias("label"), flag.alias("bad"))
    gold = ad.gold_spans(spark, d)
    return _rounded(evl.evaluate(gold, pred.join(gold.select("note_id"), "note_id", "left_semi"), ["bad"]))
