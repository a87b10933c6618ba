"""Registered queries of the operators in this folder; each applies its operator to its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clinspark.llm import bpe, covertree, fingerprints, jaccard, lines, mixing, neighbours, pii, quality, secrets, spelling, urls, whitening
from clinspark.llm.common import table

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Least score of a document that counts as good.
LEAST_QUALITY = 0.3
# Pseudonyms of the registered query; a user passes a key of their own.
DEMO_KEY = b"registered query, not a secret"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def byte_bpe() -> tuple[bytes, str]:
    """Content of the public rank file and the pattern that goes with it."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), *byte_bpe(), decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.ngram_components(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("anchors")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_anchors")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), rank_file=byte_bpe()[0])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != secrets.KINDS[-1])
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        count("guess").alias("n_guess"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    explained = F.array(*[F.lit(float(v) / model.trace if model.trace else 0.0) for v in model.values]).cast("array<double>")
    made = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return made.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_ngram_join": op5_ngram_join,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_neighbours": op9_neighbours,
    "op10_secrets": op10_secrets,
    "op11_exact_search": op11_exact_search,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}
# Links of all pairs that share a shingle, and the ids that each document reaches.
NGRAM_JOIN_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s
    FROM words WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 90 * (p.n + q.n - shared.n)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reached.doc_id, link.b FROM reached JOIN link ON link.a = reached.other
)
SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id FROM reached r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""
EXACT_SEARCH_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
# The checksum is the usual CRC-32 by bytes; the letters of a run have one or two bytes. Words one edit apart agree after leaving out one letter.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), run AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
), counted AS (
    SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 6 GROUP BY ALL
), bytes AS (
    SELECT r, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END)) AS b FROM counted
), hashed AS (
    SELECT r, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, crc
), made AS (
    SELECT CASE WHEN h % 199 = 0 THEN substring(r, 1, CAST(h % length(r) AS INTEGER)) || substring(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END AS word, n FROM hashed
), word AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
    SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
), one AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT cut.word, cut.n, w.word, w.n FROM cut JOIN word w ON w.word = cut.rest
    UNION SELECT w.word, w.n, cut.word, cut.n FROM cut JOIN word w ON w.word = cut.rest
), ranked AS (
    SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM one
), formed AS (
    SELECT word.word, CASE WHEN other_n >= 5 * word.n THEN other END AS form, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * word.n THEN other_n END AS form_n
    FROM word LEFT JOIN ranked ON ranked.word = word.word AND place = 1
), walk AS (
    SELECT word, word AS root FROM formed
    UNION ALL
    SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL
), ends AS (
    SELECT walk.word, walk.root FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NULL
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""


def url_filter_sql() -> str:
    """Rules, then Witten-Bell models of order 0 to 4 from one table per order, and the calibrated threshold."""
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules)) + " END"
    ctes = [
        f"crc AS ({CRC_TABLE})",
        "part AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "split AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM part)",
        f"ruled AS (SELECT *, {rule} AS rule, {verdict} AS ruled_verdict FROM split)",
        "hexed AS (SELECT DISTINCT url, ruled_verdict AS v, hex(encode(url)) AS h FROM ruled)",
        """one AS (SELECT url, v, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
            lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 5 = 0 AS cal FROM hexed, crc)""",
        f"padded AS (SELECT *, repeat(chr(2), {urls.ORDER}) || lower(url) || chr(3) AS p FROM one)",
        f"gram AS (SELECT url, v, cal, substr(p, i, {urls.ORDER + 1}) AS g FROM (SELECT *, unnest(generate_series(1, length(p) - {urls.ORDER})) AS i FROM padded))",
        f"s{urls.ORDER} AS (SELECT g AS s, count(*) FILTER (v = 'allow' AND NOT cal) AS na, count(*) FILTER (v = 'block' AND NOT cal) AS nr FROM gram GROUP BY 1)",
    ]
    for k in range(urls.ORDER - 1, -1, -1):
        ctes.append(f"s{k} AS (SELECT substr(s, 2) AS s, sum(na)::BIGINT AS na, sum(nr)::BIGINT AS nr FROM s{k + 1} GROUP BY 1)")
    for k in range(urls.ORDER + 1):
        ctes.append(f"c{k} AS (SELECT substr(s, 1, {k}) AS c, sum(na)::BIGINT AS ta, sum(nr)::BIGINT AS tr, count(*) FILTER (na > 0) AS ka, count(*) FILTER (nr > 0) AS kr FROM s{k} GROUP BY 1)")
        before = f"JOIN p{k - 1} q ON q.s = substr(x.s, 2)" if k else ", (SELECT 1.0::DOUBLE / (count(*) + 1) AS pa, 1.0::DOUBLE / (count(*) + 1) AS pr FROM s0) q"
        ctes.append(
            f"p{k} AS (SELECT x.s, CASE WHEN ta > 0 THEN (na + ka * q.pa) / (ta + ka) ELSE q.pa END AS pa, CASE WHEN tr > 0 THEN (nr + kr * q.pr) / (tr + kr) ELSE q.pr END AS pr FROM s{k} x JOIN c{k} c ON c.c = substr(x.s, 1, {k}) {before})"
        )
    ctes += [
        f"scored AS (SELECT url, any_value(v) AS v, any_value(cal) AS cal, floor(sum(CAST(round((ln(pa) - ln(pr)) * {urls.SCALE}) AS BIGINT)) / count(*)) AS score FROM gram JOIN p{urls.ORDER} ON s = g GROUP BY url)",
        "moment AS (SELECT avg(score) AS m, greatest(sum(score * score) / count(*) - (sum(score) / count(*)) * (sum(score) / count(*)), 0) ** 0.5 + 1 AS d, v FROM scored WHERE cal AND v IS NOT NULL GROUP BY v)",
        "level AS (SELECT coalesce((SELECT (a.m * r.d + r.m * a.d) / (a.d + r.d) FROM moment a, moment r WHERE a.v = 'allow' AND r.v = 'block'), 0) AS level)",
    ]
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, coalesce(ruled_verdict, CASE WHEN score >= level THEN 'allow' ELSE 'block' END) AS verdict FROM ruled JOIN scored USING (url), level"


ORACLES: dict[str, str] = {"op6_url_filter": url_filter_sql(), "op5_ngram_join": NGRAM_JOIN_SQL, "op11_exact_search": EXACT_SEARCH_SQL, "op12_spelling": SPELLING_SQL}
