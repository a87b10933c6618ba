"""From votes to probabilities: label matrix, majority vote and generative models."""

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from clinspark.functions.keys import hash_modulo
from clinspark.operators.lfs import has_any_vote
from clinspark.operators.stored import stored

DEFAULT_ACCURACY = 0.5
ACCURACY_RANGE = (0.05, 0.95)
DEFAULT_POSITIVE_SHARE = 0.03


def vote_code(
    kind: T.DataType, lf: str, task: str, negative: int, positive: int, abstention: int, fill: int
) -> Column:
    """One vote cell as an integer code for one task."""
    value = F.col(lf)
    if isinstance(kind, T.ArrayType):
        return F.when(F.array_contains(value, task), positive).otherwise(fill)
    if isinstance(kind, T.BooleanType):
        return F.when(value.isNull(), fill).when(value, positive).otherwise(negative)
    return F.when(value.isNull(), fill).when(value == task, positive).otherwise(abstention)


def label_matrix(
    votes: DataFrame,
    task: str,
    lfs: Sequence[str],
    negative: int = 1,
    positive: int = 2,
    abstention: int = 0,
    fill_negative: Sequence[str] | None = None,
    drop_all_abstaining: bool = False,
    note: str = "note_id",
    prefix: str = "",
) -> DataFrame:
    """Replace (or add, with a prefix) each labelling function column by its integer code for the task.

    Array votes count when they hold the task; other tasks abstain; missing votes are negative for the
    functions in `fill_negative` and abstain otherwise. Optionally drops notes without any vote.
    """
    kinds = {lf: votes.schema[lf].dataType for lf in lfs}
    if drop_all_abstaining:
        raw = {
            f"_raw_{lf}": F.when(F.array_contains(lf, task), 1) if isinstance(kinds[lf], T.ArrayType) else F.col(lf)
            for lf in lfs
        }
        votes = has_any_vote(votes.withColumns(raw), list(raw), note).filter(~F.col("all_abstain"))
        votes = votes.drop("all_abstain", *raw)
    fill = {lf: negative if lf in (fill_negative or ()) else abstention for lf in lfs}
    codes = {
        f"{prefix}{lf}": vote_code(kinds[lf], lf, task, negative, positive, abstention, fill[lf]).cast("int")
        for lf in lfs
    }
    return votes.withColumns(codes)


# ---------------------------------------------------------------- majority vote


def majority_probs(lfs: Sequence[str], classes: Sequence[int], prefix: str = "") -> list[Column]:
    """Probability of each class: the classes with most votes share 1; no votes give a uniform split."""
    counts = [sum((F.when(F.col(f"`{prefix}{lf}`") == c, 1).otherwise(0) for lf in lfs), F.lit(0)) for c in classes]
    top = F.greatest(*counts)
    wins = [F.when(n == top, 1.0).otherwise(0.0) for n in counts]
    total = sum(wins[1:], wins[0])
    return [w / total for w in wins]


def majority_vote(matrix: DataFrame, lfs: Sequence[str], classes: Sequence[int] = (0, 1), abstention: int = -1, name: str = "prob", prefix: str = "") -> DataFrame:
    if abstention not in (-1, 0):
        raise ValueError("abstention must be -1 or 0")
    probs = majority_probs(lfs, classes, prefix)
    return matrix.withColumns({f"{name}_{i}": p for i, p in enumerate(probs)})


def majority_label(
    probs: DataFrame, key: Sequence[str], classes: Sequence[int] = (0, 1), seed=0, name: str = "prob", tie_class: int | None = None
) -> DataFrame:
    """Hard label in the vote coding; ties take a fixed class or a repeatable coin per row."""
    columns = [F.col(f"{name}_{i}") for i in range(len(classes))]
    top = F.greatest(*columns)
    winners = F.filter(
        F.array(*[F.when(c == top, F.lit(int(k))) for c, k in zip(columns, classes)]), lambda k: k.isNotNull()
    )
    coin = hash_modulo(F.size(winners), seed, *key).cast("int")
    chosen = F.get(winners, coin)
    if tie_class is not None:
        chosen = F.when(F.size(winners) > 1, F.lit(int(tie_class))).otherwise(F.get(winners, F.lit(0)))
    return probs.withColumn("label_majority", chosen)


# ---------------------------------------------------------------- generative models


def signed(lf: str, negative: int, positive: int) -> Column:
    vote = F.col(f"`{lf}`")
    return F.when(vote == positive, 1).when(vote == negative, -1).otherwise(0)


def vote_column(matrix: DataFrame, task: str, lf: str) -> str:
    name = f"{task}:{lf}"
    return name if name in matrix.columns else lf


# Characters of a pattern: one for each function, in the order of the task's functions.
FOR, AGAINST, ABSENT = "+", "-", "0"


def vote_patterns(
    matrix: DataFrame, lfs_by_task: Mapping[str, Sequence[str]], negative: int, positive: int, kept: Mapping[str, Column] | None = None,
    gold: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(task, pattern, kept, gold, n): how many spans vote in which way, for all tasks in one pass.

    A pattern has a character for each function of the task: for, against or absent. Spans are counted by pattern before the shuffle, and
    there are as many rows as ways to vote, whatever the number of spans; fits, summaries and metrics need no more. `kept` marks the spans
    that a task is fitted on (all by default), `gold` is a label code per task.
    """
    rows = []
    for task, lfs in lfs_by_task.items():
        marks = []
        for lf in lfs:
            vote = F.col(f"`{vote_column(matrix, task, lf)}`")
            marks.append(F.when(vote == positive, FOR).when(vote == negative, AGAINST).otherwise(ABSENT))
        rows.append(
            F.struct(
                F.lit(task).alias("task"), F.concat(F.lit(""), *marks).alias("pattern"),
                F.coalesce(kept[task], F.lit(False)).alias("kept") if kept else F.lit(True).alias("kept"),
                (gold[task] if gold else F.lit(None)).cast("int").alias("gold"),
            )
        )
    return matrix.select(F.inline(F.array(*rows))).groupBy("task", "pattern", "kept", "gold").agg(F.count(F.lit(1)).alias("n"))


def _sign(mark: Column) -> Column:
    return F.when(mark == FOR, 1).when(mark == AGAINST, -1).otherwise(0)


def _function_rows(session, lfs_by_task: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(task, lf, i) for task, lfs in lfs_by_task.items() for i, lf in enumerate(lfs)]
    return session.createDataFrame(rows, "task string, lf string, at int")


def pair_moments(patterns: DataFrame) -> DataFrame:
    """(task, i, j, moment): mean product of two functions, by their places, where both vote on kept spans."""
    marks = F.split("pattern", "")
    one = patterns.filter("kept").select("task", "n", marks.alias("marks"), F.posexplode(marks).alias("i", "a")).filter(F.col("a").isin(FOR, AGAINST))
    two = one.select("task", "n", "i", "a", F.posexplode("marks").alias("j", "b")).filter(F.col("b").isin(FOR, AGAINST) & (F.col("i") != F.col("j")))
    agreed = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(-F.col("n"))
    return two.groupBy("task", "i", "j").agg((F.sum(agreed) / F.sum("n")).alias("moment"))


def triplet_fit_patterns(patterns: DataFrame, lfs_by_task: Mapping[str, Sequence[str]]) -> DataFrame:
    """(task, lf, accuracy): closed-form estimates from triples of functions, without gold.

    |a_i| is the median over pairs (j, k) of sqrt(|M_ij M_ik / M_jk|), clipped; 0.5 when no triple exists.
    """
    session = patterns.sparkSession
    names = _function_rows(session, lfs_by_task)
    triples = [
        (task, i, f"{task}|{i}|{j}", f"{task}|{i}|{k}", f"{task}|{j}|{k}")
        for task, lfs in lfs_by_task.items()
        for i in range(len(lfs))
        for j, k in combinations([at for at in range(len(lfs)) if at != i], 2)
    ]
    if not triples:
        return names.select("task", "lf", F.lit(DEFAULT_ACCURACY).alias("accuracy"))
    # The moments come back as one small map value, looked up by every triple of the configuration.
    entry = F.struct(F.concat_ws("|", "task", "i", "j"), "moment")
    table = pair_moments(patterns).agg(F.map_from_entries(F.collect_list(entry))).scalar()
    rows = session.createDataFrame(triples, "task string, at int, ij string, ik string, jk string").withColumn("_m", table)
    ij, ik, jk = (F.try_element_at("_m", F.col(c)) for c in ("ij", "ik", "jk"))
    ratios = rows.select("task", "at", F.when(jk != 0, F.sqrt(F.abs(ij * ik / jk))).alias("ratio"))
    fitted = ratios.groupBy("task", "at").agg(F.percentile("ratio", F.lit(0.5)).alias("a"))
    low, high = ACCURACY_RANGE
    clipped = F.least(F.greatest(F.coalesce(F.col("a"), F.lit(DEFAULT_ACCURACY)), F.lit(low)), F.lit(high))
    return names.join(fitted, ["task", "at"], "left").select("task", "lf", clipped.alias("accuracy"))


def triplet_fit_tasks(
    matrix: DataFrame, lfs_by_task: Mapping[str, Sequence[str]], negative: int = -1, positive: int = 1,
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """`triplet_fit_patterns` on a label matrix; `keep` limits the spans of a task."""
    return triplet_fit_patterns(vote_patterns(matrix, lfs_by_task, negative, positive, keep), lfs_by_task)


def triplet_fit(matrix: DataFrame, lfs: Sequence[str], negative: int = -1, positive: int = 1) -> DataFrame:
    """(lf, accuracy) of one task."""
    return triplet_fit_tasks(matrix, {"": lfs}, negative, positive).select("lf", "accuracy")


def fitted_values(fit: DataFrame) -> dict[str, float]:
    """Accuracies as driver values: one row per labelling function."""
    return {row["lf"]: row["accuracy"] for row in fit.select("lf", "accuracy").collect()}


def posterior(lfs: Mapping[str, float], positive_share: float, negative: int = -1, positive: int = 1, prefix: str = "") -> Column:
    """P(positive): prior log-odds plus one log-ratio per vote."""
    odds = F.lit(math.log(positive_share / (1 - positive_share)))
    for lf, a in lfs.items():
        odds = odds + signed(f"{prefix}{lf}", negative, positive) * F.lit(math.log((1 + a) / (1 - a)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def predict_probs(
    matrix: DataFrame, accuracies: Mapping[str, float] | DataFrame, positive_share: float = DEFAULT_POSITIVE_SHARE,
    negative: int = -1, positive: int = 1, name: str = "prob", prefix: str = "",
) -> DataFrame:
    values = fitted_values(accuracies) if isinstance(accuracies, DataFrame) else accuracies
    p1 = posterior(values, positive_share, negative, positive, prefix)
    return matrix.withColumn(f"{name}_1", p1).withColumn(f"{name}_0", 1 - F.col(f"{name}_1"))


def pattern_odds(accuracies: Column, share: Column) -> Column:
    """Log-odds of a positive span with a pattern, by the accuracies of its functions (an array in their order) and the share of positives."""
    logs = F.transform(accuracies, lambda a: F.log((1 + a) / (1 - a)))
    votes = F.zip_with(F.split("pattern", ""), logs, lambda mark, weight: _sign(mark) * F.coalesce(weight, F.lit(0.0)))
    return F.aggregate(votes, F.log(share / (1 - share)), lambda total, vote: total + vote)


def with_parameters(patterns: DataFrame, accuracies: Mapping[str, Sequence[float]], shares: Mapping[str, float]) -> DataFrame:
    """Patterns of the given tasks with `p`, the probability of a positive span; the parameters are one row per task."""
    rows = [(task, [float(a) for a in values], float(shares[task])) for task, values in accuracies.items()]
    parameters = patterns.sparkSession.createDataFrame(rows, "task string, accuracies array<double>, share double")
    joined = patterns.join(F.broadcast(parameters), "task")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-pattern_odds(F.col("accuracies"), F.col("share"))))
    return joined.withColumn("p", p).drop("accuracies", "share")


def em_fit_patterns(
    patterns: DataFrame, lfs_by_task: Mapping[str, Sequence[str]], shares: Mapping[str, float], max_iterations: int = 30, tolerance: float = 1e-4
) -> DataFrame:
    """(task, lf, accuracy, correct_rate) by expectation-maximisation on counted patterns, for all tasks in the same rounds.

    A round is one aggregate over the patterns of the tasks that still move: two sums per function reach the driver, and the next round takes
    them as one row per task, so the plan does not grow. A task is done when no accuracy moves by the tolerance.
    """
    accuracy = {task: [2 * 0.7 - 1] * len(lfs) for task, lfs in lfs_by_task.items()}
    moving = [task for task, lfs in lfs_by_task.items() if lfs]
    counted = patterns.filter("kept").groupBy("task", "pattern").agg(F.sum("n").alias("n"))
    for _ in range(max_iterations):
        if not moving:
            break
        scored = with_parameters(counted, {t: accuracy[t] for t in moving}, shares)
        votes = scored.select("task", "n", "p", F.posexplode(F.split("pattern", "")).alias("at", "mark")).filter(F.col("mark").isin(FOR, AGAINST))
        agreed = F.col("n") * F.when(F.col("mark") == FOR, F.col("p")).otherwise(1 - F.col("p"))
        sums = votes.groupBy("task", "at").agg(F.sum(agreed).alias("agreed"), F.sum("n").alias("voted")).collect()
        found = {(r["task"], r["at"]): (r["agreed"], r["voted"]) for r in sums}
        settled = []
        for task in moving:
            new = []
            for at in range(len(accuracy[task])):
                right, voted = found.get((task, at), (0.0, 0))
                new.append(min(max(2 * (right + 1) / (voted + 2) - 1, -ACCURACY_RANGE[1]), ACCURACY_RANGE[1]))
            if max(abs(x - y) for x, y in zip(new, accuracy[task])) < tolerance:
                settled.append(task)
            accuracy[task] = new
        moving = [task for task in moving if task not in settled]
    rows = [(task, lf, a, (1 + a) / 2) for task, lfs in lfs_by_task.items() for lf, a in zip(lfs, accuracy[task])]
    return patterns.sparkSession.createDataFrame(rows, "task string, lf string, accuracy double, correct_rate double")


def em_fit(
    matrix: DataFrame, lfs: Sequence[str], positive_share: float = DEFAULT_POSITIVE_SHARE, negative: int = -1,
    positive: int = 1, max_iterations: int = 30, tolerance: float = 1e-4,
) -> DataFrame:
    """(lf, accuracy, correct_rate) of one task; the spans are read once, for their patterns."""
    patterns = stored(vote_patterns(matrix, {"": lfs}, negative, positive))
    return em_fit_patterns(patterns, {"": lfs}, {"": positive_share}, max_iterations, tolerance).select("lf", "accuracy", "correct_rate")


def majority_of_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns with `p`, the majority's probability of a positive span."""
    balance = F.aggregate(F.split("pattern", ""), F.lit(0), lambda total, mark: total + _sign(mark))
    return patterns.withColumn("p", F.when(balance > 0, 1.0).when(balance < 0, 0.0).otherwise(0.5))


def pattern_summary(
    patterns: DataFrame, lfs_by_task: Mapping[str, Sequence[str]], negative: int, positive: int, with_gold: bool = False
) -> DataFrame:
    """Per task and labelling function: polarity, coverage, overlaps, conflicts and, with gold labels, accuracy, on the kept spans."""
    votes = F.length(F.replace(F.col("pattern"), F.lit(ABSENT), F.lit("")))
    both = F.col("pattern").contains(FOR) & F.col("pattern").contains(AGAINST)
    marks = patterns.filter("kept").select("task", "n", "gold", votes.alias("votes"), both.alias("both"), F.posexplode(F.split("pattern", "")).alias("at", "mark"))
    cast = F.col("mark").isin(FOR, AGAINST)
    code = F.when(F.col("mark") == FOR, positive).when(F.col("mark") == AGAINST, negative)

    def count(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0).cast("bigint")))

    grouped = marks.groupBy("task", "at").agg(
        F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set(code)), "|").alias("polarity"), count(cast).alias("covered"),
        count(cast & (F.col("votes") > 1)).alias("shared"), count(cast & F.col("both")).alias("against"), count(code == F.col("gold")).alias("correct"),
    )
    shares = [(F.col(c) / F.col("n")).alias(name) for c, name in (("covered", "coverage"), ("shared", "overlaps"), ("against", "conflicts"))]
    judged = []
    if with_gold:
        wrong = (F.col("covered") - F.col("correct")).alias("incorrect")
        judged = ["correct", wrong, F.when(F.col("covered") > 0, F.col("correct") / F.col("covered")).alias("accuracy")]
    names = _function_rows(patterns.sparkSession, lfs_by_task)
    return names.join(grouped, ["task", "at"], "left").select("task", "lf", F.coalesce("polarity", F.lit("")).alias("polarity"), *shares, *judged)


def pattern_metrics(scored: DataFrame, positive: int, threshold: float = 0.5) -> DataFrame:
    """(task, support, instances, precision, recall, fscore) of patterns with `p` and gold labels, all spans counted.

    A span is called positive above the threshold; a measure without a denominator is 0.
    """
    called, right = F.col("p") > threshold, F.col("gold") == positive

    def count(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0).cast("bigint")))

    counts = scored.groupBy("task").agg(
        count(right).alias("support"), F.sum("n").alias("instances"), count(called).alias("called"), count(called & right).alias("hits")
    )
    precision = F.when(F.col("called") > 0, F.col("hits") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    both = F.col("called") + F.col("support")
    fscore = F.when(both > 0, 2 * F.col("hits") / both).otherwise(0.0)
    return counts.select("task", "support", "instances", precision.alias("precision"), recall.alias("recall"), fscore.alias("fscore"))


LABEL_MODELS = {"majority": None, "triplet": triplet_fit, "em": em_fit}


def rescale_probs(df: DataFrame, p1: str, p0: str, floor: float = 0.5) -> DataFrame:
    """Divide positive probabilities by their maximum when that is below the floor."""
    top = df.agg(F.max(p1)).scalar()
    scaled = F.when(top < floor, F.col(p1) / top).otherwise(F.col(p1))
    return df.withColumn(p1, scaled).withColumn(p0, 1 - F.col(p1))


# ---------------------------------------------------------------- summaries


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) keyed by class value."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)


def positive_share(df: DataFrame, label: str, positive: int, default: float = DEFAULT_POSITIVE_SHARE, minimum_support: int = 1) -> float:
    """Share of positives on the gold set, or the default when there are too few."""
    row = df.agg(F.count_if(F.col(label) == positive).alias("k"), F.count(label).alias("n")).first()
    if row["k"] >= minimum_support and row["n"] > row["k"]:
        return row["k"] / row["n"]
    return default


def lf_summary(matrix: DataFrame, lfs: Sequence[str], abstention: int = 0, gold: str | None = None) -> DataFrame:
    """Per labelling function: polarity, coverage, overlaps, conflicts and, with gold, accuracy; one pass."""
    votes = [F.when(F.col(lf) != abstention, F.col(lf)) for lf in lfs]
    n_votes = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in votes), F.lit(0))
    marked = matrix.select(
        *[v.alias(f"v{i}") for i, v in enumerate(votes)],
        n_votes.alias("_n"),
        F.least(*votes).alias("_low") if len(lfs) > 1 else votes[0].alias("_low"),
        F.greatest(*votes).alias("_high") if len(lfs) > 1 else votes[0].alias("_high"),
        *([F.col(gold).alias("_gold")] if gold else []),
    )
    measures = [F.count(F.lit(1)).alias("n")]
    for i in range(len(lfs)):
        v = F.col(f"v{i}")
        measures += [
            F.count(v).alias(f"c{i}"),
            F.count_if(v.isNotNull() & (F.col("_n") > 1)).alias(f"o{i}"),
            F.count_if(v.isNotNull() & (F.col("_low") < F.col("_high"))).alias(f"x{i}"),
            F.array_join(F.sort_array(F.collect_set(v)), "|").alias(f"p{i}"),
        ]
        if gold:
            measures.append(F.count_if(v == F.col("_gold")).alias(f"g{i}"))
    one = marked.agg(*measures)

    def share(count):
        return F.when(F.col("n") > 0, F.col(count) / F.col("n"))

    rows = []
    for i, lf in enumerate(lfs):
        fields = [
            F.lit(lf).alias("lf"),
            F.col(f"p{i}").alias("polarity"),
            share(f"c{i}").alias("coverage"),
            share(f"o{i}").alias("overlaps"),
            share(f"x{i}").alias("conflicts"),
        ]
        if gold:
            fields += [
                F.col(f"g{i}").alias("correct"),
                (F.col(f"c{i}") - F.col(f"g{i}")).alias("incorrect"),
                F.when(F.col(f"c{i}") > 0, F.col(f"g{i}") / F.col(f"c{i}")).alias("accuracy"),
            ]
        rows.append(F.struct(*fields))
    return one.select(F.inline(F.array(*rows)))


def prob_histogram(df: DataFrame, prob: str, digits: int = 5) -> DataFrame:
    """Counts per rounded probability."""
    return df.groupBy(F.round(prob, digits).alias("prob")).agg(F.count(F.lit(1)).alias("n"))


def threshold_counts(df: DataFrame, prob: str, threshold: float = 0.5) -> DataFrame:
    return df.agg(
        F.count_if(F.col(prob) >= threshold).alias("n_positive"), F.count_if(F.col(prob) < threshold).alias("n_negative")
    )
