"""URL filters: suffix rules first, then a character language-model ratio learned from the URLs that rules judge."""

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.llm.common import checkpointed

# (verdict, host, path prefix); a rule fits its host and all subdomains.
Rule = tuple[str, str, str]
ORDER = 4
START, END = "\x02", "\x03"
# Log-likelihood ratios are whole millionths of a nat, so that sums don't depend on their order.
SCALE = 1_000_000
# One part in CALIBRATION of the rule-judged URLs sets the threshold; the others fill the models.
CALIBRATION = 5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text (host + path) and verdict of the longest rule that fits; null where none does. Rules are configuration."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def pick(value):
        chosen = F.lit(None).cast("string")
        for rule in reversed(ordered):
            fits = ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))
            chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
        return chosen

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def grams(url: Column, order: int = ORDER) -> Column:
    """Windows of `order` characters and the next one, over the lower-cased URL with start and end marks."""
    padded = F.split(F.concat(F.lit(START * order), F.lower(url), F.lit(END)), "")

    def windows(characters):
        # Cut from the array of characters, so that a long URL costs as much a character as a short one.
        return F.transform(F.sequence(F.lit(1), F.size(characters) - order), lambda i: F.array_join(F.slice(characters, i, order + 1), ""))

    return F.get(F.transform(F.array(padded), windows), 0)


def gram_ratios(distinct: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, accepted, rejected) counts -> (gram, ratio): log of both models' probabilities of the gram's last character.

    Each class has a variable-order Markov model: from order 0 up, p = (n(context, char) + kinds(context) * p of the shorter
    context) / (n(context) + kinds(context)), Witten and Bell's smoothing, above a uniform start over all characters seen and
    one unseen. A context that a class has never seen leaves p as it is.

    The orders are built one on the other: a table has a row for each sequence of k + 1 characters, so a context never has more rows
    than there are characters, and takes the probabilities of the shorter contexts from the table of k - 1.
    """
    tables = {order: distinct.select(F.col("gram").alias("suffix"), F.col("accepted").alias("na"), F.col("rejected").alias("nr"))}
    for k in range(order - 1, -1, -1):
        shorter = tables[k + 1].groupBy(F.substring(F.col("suffix"), F.lit(2), F.lit(k + 1)).alias("suffix"))
        tables[k] = checkpointed(shorter.agg(F.sum("na").alias("na"), F.sum("nr").alias("nr")))
    totals = [
        F.sum("na").alias("ta"), F.sum("nr").alias("tr"),
        F.sum((F.col("na") > 0).cast("bigint")).alias("ka"), F.sum((F.col("nr") > 0).cast("bigint")).alias("kr"),
    ]

    def smoothed(side: str, before: Column) -> Column:
        n, t, d = F.col(f"n{side}"), F.col(f"t{side}"), F.col(f"k{side}")
        return F.when(t > 0, (n + d * before) / (t + d)).otherwise(before)

    # Order 0 has one context, whose totals are one row.
    whole = tables[0].agg(*totals, F.count(F.lit(1)).alias("kinds")).first()
    start = F.lit(1.0) / (F.lit(whole["kinds"]) + 1)
    known = tables[0].withColumns({c: F.lit(whole[c]).cast("bigint") for c in ("ta", "tr", "ka", "kr")})
    made = known.select("suffix", smoothed("a", start).alias("pa"), smoothed("r", start).alias("pr"))
    for k in range(1, order + 1):
        table = tables[k].withColumns({"context": F.substring("suffix", 1, k), "short": F.substring(F.col("suffix"), F.lit(2), F.lit(k))})
        contexts = table.groupBy("context").agg(*totals)
        shorter = made.select(F.col("suffix").alias("short"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        joined = table.join(contexts, "context").join(shorter, "short")
        made = joined.select("suffix", smoothed("a", F.col("qa")).alias("pa"), smoothed("r", F.col("qr")).alias("pr"))
    ratio = F.round((F.ln("pa") - F.ln("pr")) * SCALE).cast("bigint")
    return made.select(F.col("suffix").alias("gram"), ratio.alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[Rule], url_column: str = "url", order: int = ORDER) -> DataFrame:
    """Add host, path, rule, verdict and score to pages.

    verdict is that of the longest fitting rule. For all other URLs two models of characters, of the accepted and of the rejected
    URLs that rules judge, give a log-likelihood difference per character (`score`, in millionths of a nat). The
    verdict is `allow` at or above the threshold that lies as many standard deviations below the mean of accepted
    as above the mean of rejected calibration URLs. One in CALIBRATION of the judged URLs (by CRC-32) calibrates, the others count;
    models, scores and calibration work on distinct URLs, so a hot URL weighs once.

    Null URLs and URLs without `://` have empty host and path, no rule, and are scored as they stand (null: as empty). Without
    accepted or rejected URLs all scores are 0 and the verdict is `allow`; without calibration URLs the threshold is 0.
    Repeated rows stay; all columns of `pages` stay but those named like a result column.
    """
    made = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in pages.columns if c.lower() not in made]
    # The user's columns travel in one struct, so that no name used here meets one of theirs.
    rows = pages.select(F.coalesce(F.col(url_column), F.lit("")).alias("url"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    host, path = url_parts(F.col("url"))
    urls = rows.select("url").distinct().withColumn("verdict", matching_rule(host, path, rules)[1])
    group = F.pmod(F.crc32(F.encode(F.col("url"), "UTF-8")), F.lit(CALIBRATION))
    # Grams carry a short number of their URL, fixed by the checkpoint, and meet its text again at the end only.
    urls = checkpointed(urls.withColumns({"calibrates": group == 0, "id": F.monotonically_increasing_id()}))
    placed = urls.select("id", "verdict", "calibrates", F.explode(grams(F.col("url"), order)).alias("gram"))

    def counted(verdict):
        return F.sum((F.coalesce(F.col("verdict") == verdict, F.lit(False)) & ~F.col("calibrates")).cast("bigint"))

    distinct = checkpointed(placed.groupBy("gram").agg(counted("allow").alias("accepted"), counted("block").alias("rejected")))
    # A gram that a URL repeats moves once; one that every URL holds is split by the adaptive skew join.
    own = placed.groupBy("id", "gram").agg(F.count(F.lit(1)).alias("times"))
    sums = own.join(gram_ratios(distinct, order), "gram").groupBy("id").agg(F.sum(F.col("ratio") * F.col("times")).alias("sum"), F.sum("times").alias("n"))
    scored = urls.join(sums, "id").select("url", "verdict", "calibrates", F.floor(F.col("sum") / F.col("n")).alias("score"))
    scored = checkpointed(scored)
    moments = scored.filter(F.col("calibrates") & F.col("verdict").isNotNull()).groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum((F.col("score") * F.col("score")).cast("decimal(38,0)")).alias("q")
    )
    trained = urls.filter(F.col("verdict").isNotNull() & ~F.col("calibrates")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    both = {r["verdict"] for r in trained.collect()} >= {"allow", "block"}  # at most one row per verdict
    level = threshold({r["verdict"]: (r["n"], r["s"], int(r["q"])) for r in moments.collect()}) if both else 0.0
    score = F.col("score") if both else F.lit(0).cast("bigint")
    joined = rows.join(scored.select("url", score.alias("score")), "url")
    rule, verdict = matching_rule(host, path, rules)
    method = F.when(F.col("score") >= F.lit(level), F.lit("allow")).otherwise(F.lit("block"))
    return joined.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("score"),
    )


def threshold(moments: dict[str, tuple[int, int, int]]) -> float:
    """The score as many standard deviations below the accepted as above the rejected mean, from counts, sums and squares."""
    if not {"allow", "block"} <= set(moments):
        return 0.0
    (na, sa, qa), (nr, sr, qr) = moments["allow"], moments["block"]
    ma, mr = sa / na, sr / nr
    da, dr = max(qa / na - ma * ma, 0.0) ** 0.5 + 1.0, max(qr / nr - mr * mr, 0.0) ** 0.5 + 1.0
    return (ma * dr + mr * da) / (da + dr)
