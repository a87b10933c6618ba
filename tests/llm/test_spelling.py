"""Spelling variants against plain loops over all words."""

import random
import re
import zlib
from collections import Counter

from clinspark.llm import queries, spelling
from clinspark.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    n = plain_words(docs)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return rows


def got(df):
    rows = spelling.variants(df).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_given_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    rows = queries.op12_spelling(spark, sf_dir).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == plain_variants(docs)


def test_random_variants(spark, documents):
    """Edits of every kind at every place, with accents, over few letters, so that many words have the same letters."""
    rng = random.Random(3)
    letters, texts = "aeté×ÿ", []
    for base in ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(25)]:
        words = {base: 150}
        for _ in range(8):
            w, at = rng.choice(sorted(words)), rng.randint(0, 6)
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words.setdefault(w, rng.choice([5, 6, 25, 30]))
        texts += [" ".join(w.upper() if k % 2 and w.isascii() else w for k in range(c)) for w, c in words.items()]
    docs = list(enumerate(texts))
    want = plain_variants(docs)
    assert got(documents(docs)) == want
    assert sum(v[3] for v in want.values()) > 100 and any(v[0] is not None and v[0] != v[1] for v in want.values())


def test_hot_letters(spark, documents):
    """Hundreds of words made of the same letters meet on the same parts and are told apart by their halves."""
    rng = random.Random(4)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(400)} | {"abcdefgx", "abcdefghh"}
    docs = [(k, " ".join([w] * 5)) for k, w in enumerate(sorted(words))]
    assert got(documents(docs)) == plain_variants(docs)


def test_odd_rows(spark, documents, no_rows, edges):
    assert got(no_rows) == {}
    docs = [*edges, (8, "word-word123word " * 3), (9, "Straße straße STRASSE " * 9), (None, "hidden hidden hidden hidden hiddens"), (None, "hidden")]
    assert got(documents(docs)) == plain_variants(docs)
    long = "ab" * 5000
    docs = [(1, f"{long} " * 5 + f"{long}c " * 30), (1, f"{long} " * 5)]
    assert got(documents(docs)) == plain_variants(docs)
