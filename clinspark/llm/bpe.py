"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside the partitions."""

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator
from itertools import islice, repeat

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Pieces that one query contracts, and pieces after which a batch of documents is passed on.
PIECES = 100_000
# Different pieces whose tokens a worker remembers; beyond that it forgets them and starts anew.
REMEMBERED = 500_000
DUCKDB_MEMORY = "300MB"

# Words up to LONG bytes take one contraction a step; it costs less a step and there are few. `i` numbers the tokens of a word.
LONG = 255
CONTRACT_ONE = """
WITH RECURSIVE steps AS (
    SELECT 0 AS step, w, i, t FROM start
    UNION ALL
    SELECT step + 1, w, i - CAST(i > place AS INTEGER), CASE WHEN i = place THEN c ELSE t END FROM (
        SELECT s.step, s.w, s.i, s.t, CAST(best & 255 AS INTEGER) AS place, CAST(best >> 8 AS INTEGER) AS c
        FROM steps s JOIN (
            SELECT a.w, min((m.c::BIGINT << 8) | a.i) AS best
            FROM steps a JOIN steps b ON b.w = a.w AND b.i = a.i + 1 JOIN merges m ON m.a = a.t AND m.b = b.t
            GROUP BY a.w
        ) USING (w)
    ) WHERE i <> place + 1
)
SELECT w, i, t, 0 AS last FROM steps JOIN (SELECT w, max(step) AS step FROM steps GROUP BY w) USING (w, step) ORDER BY w, i
"""
# Steps of one recursive query on longer words; it starts again from where it stopped, so what it holds stays a small multiple of its input.
STEPS = 48

# start(w, i, t): word, position and token. Each step looks up every adjacent pair in merges(a, b, c), where the id c is
# also the rank, and contracts the leftmost pair of least rank of each word. The next contractions of that word are those of
# the same rank further right (in a run of overlapping pairs, a a a, every second one) unless the new token makes a pair of
# lower rank with a neighbour; so a step does them at once, from left to right up to the first that makes such a pair.
# Words without a pair stop. `inverted` holds the pairs whose rank is below that of one of their parts.
CONTRACT = f"""
WITH RECURSIVE steps AS (
    SELECT 0 AS step, w, i, t FROM start
    UNION ALL
    SELECT step + 1, w, i, CASE WHEN taken THEN best ELSE t END FROM (
        SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY i), false) AS gone FROM (
            SELECT *, even AND coalesce(sum(CASE WHEN risky THEN 1 ELSE 0 END) OVER before, 0) = 0 AS taken FROM (
                SELECT e.*, even AND (l.a IS NOT NULL OR r.a IS NOT NULL) AS risky FROM (
                    SELECT *, CASE WHEN lag(even, 2) OVER place THEN best ELSE lag(t) OVER place END AS left_t, lead(t, 2) OVER place AS right_t FROM (
                        SELECT *, hit AND (n - coalesce(max(CASE WHEN NOT hit THEN n END) OVER past, 0)) % 2 = 1 AS even FROM (
                            SELECT *, coalesce(c = best, false) AS hit FROM (
                                SELECT p.*, m.c, min(m.c) OVER (PARTITION BY p.w) AS best FROM (
                                    SELECT step, w, i, t, lead(t) OVER (PARTITION BY w ORDER BY i) AS u,
                                           row_number() OVER (PARTITION BY w ORDER BY i) AS n FROM steps WHERE step < {STEPS}
                                ) p LEFT JOIN merges m ON m.a = p.t AND m.b = p.u
                            )
                        ) WHERE best IS NOT NULL
                        WINDOW past AS (PARTITION BY w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    ) WINDOW place AS (PARTITION BY w ORDER BY i)
                ) e
                LEFT JOIN inverted l ON l.a = e.left_t AND l.b = CASE WHEN even THEN best END AND l.c < best
                LEFT JOIN inverted r ON r.a = CASE WHEN even THEN best END AND r.b = e.right_t AND r.c < best
            ) WINDOW before AS (PARTITION BY w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        )
    ) WHERE NOT gone
)
SELECT w, i, t, last FROM (SELECT w, i, t, step, max(step) OVER (PARTITION BY w) AS last FROM steps) WHERE step = last ORDER BY w, i
"""
DECODE = "SELECT d, string_agg(v.hex, '' ORDER BY p) AS hex FROM tokens JOIN vocabulary v USING (t) GROUP BY d"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token -> rank of a file with lines `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Codec:
    """One DuckDB connection with the merge table and the vocabulary, and the pieces seen so far."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.pattern = regex.compile(pattern)
        spill = os.path.join(tempfile.gettempdir(), f"duckdb-{os.getpid()}")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": spill})
        merges = []
        for token, c in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    merges.append((a, b, c))
        for name, rows in (("merges", merges), ("inverted", [m for m in merges if m[2] < max(m[:2])])):
            self._table(name, pa.table({k: pa.array([m[n] for m in rows], pa.int32()) for n, k in enumerate("abc")}))
        ids = pa.array(list(self.ranks.values()), pa.int32())
        self._table("vocabulary", pa.table({"t": ids, "hex": pa.array([x.hex() for x in self.ranks], pa.string())}))
        self.token_bytes = np.zeros(max(self.ranks.values(), default=0) + 1, np.int64)
        self.token_bytes[list(self.ranks.values())] = [len(x) for x in self.ranks]
        self.of_byte = np.array([self.ranks.get(bytes([x]), -1) for x in range(256)], np.int32)
        self._forget()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.byte_lengths = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.uint8)
        self.byte_starts = np.zeros(0, np.int64)

    def _contract(self, word: np.ndarray, place: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and token of what is left of the words when no pair of theirs can be contracted."""
        is_long = np.bincount(word)[word] > LONG
        ended = []
        for query, part in ((CONTRACT_ONE, ~is_long), (CONTRACT, is_long)):
            w, i, t = word[part], place[part], token[part]
            while len(w):
                self.db.register("start", pa.table({"w": w, "i": i.astype(np.int32), "t": t}))
                found = {k: np.asarray(v) for k, v in self.db.execute(query).fetchnumpy().items()}
                self.db.unregister("start")
                goes_on = found["last"] == STEPS
                ended.append((found["w"][~goes_on], found["t"][~goes_on]))
                w, i, t = (found[k][goes_on] for k in "wit")
        words, tokens = (np.concatenate(x) for x in zip(*ended))
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def _learn(self, pieces: list[str]) -> None:
        """Tokens of new pieces: whole pieces of the vocabulary at once, the others by contraction."""
        coded = [p.encode("utf-8") for p in pieces]
        known = [self.ranks.get(b) for b in coded]
        lengths = np.ones(len(pieces), np.int64)
        open_ones = [n for n, k in enumerate(known) if k is None]
        contracted = np.zeros(0, np.int32)
        if open_ones:
            sizes = np.array([len(coded[n]) for n in open_ones])
            flat = self.of_byte[np.frombuffer(b"".join(coded[n] for n in open_ones), np.uint8)]
            if (flat < 0).any():
                raise ValueError("the vocabulary lacks a single byte")
            word = np.repeat(np.arange(len(open_ones), dtype=np.int32), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            word, contracted = self._contract(word, place, flat)
            lengths[open_ones] = np.bincount(word, minlength=len(open_ones))
        tokens = np.zeros(int(lengths.sum()), np.int32)
        is_open = np.zeros(len(pieces), bool)
        is_open[open_ones] = True
        from_open = np.repeat(is_open, lengths)
        tokens[from_open] = contracted
        tokens[~from_open] = [k for k in known if k is not None]
        for p in pieces:
            self.code[p] = len(self.code)
        self.lengths = np.concatenate([self.lengths, lengths])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.starts = np.cumsum(self.lengths) - self.lengths
        # One ordered aggregation decodes all new pieces; the lengths of their tokens say where each ends.
        text = self.decode(tokens, np.zeros(len(tokens), np.int32), 1)[0]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        sizes = np.bincount(owner, self.token_bytes[tokens], minlength=len(pieces)).astype(np.int64)
        self.byte_lengths = np.concatenate([self.byte_lengths, sizes])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(text, np.uint8)])
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths

    def encode(self, pieces: list[str]) -> np.ndarray:
        """Codes of the pieces, to be given to `spread` before the next call."""
        codes = np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))
        if (codes < 0).any():
            new = list(dict.fromkeys(pieces[k] for k in np.flatnonzero(codes < 0).tolist()))
            if len(self.code) + len(new) > REMEMBERED and self.code:
                self._forget()
                new = list(dict.fromkeys(pieces))
            self._learn(new)
            codes = np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces))
        return codes

    def spread(self, codes: np.ndarray, decoded: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the pieces and their tokens one after the other; with `decoded` the bytes that their tokens decode to."""
        of, flat, starts = (self.byte_lengths, self.bytes, self.byte_starts) if decoded else (self.lengths, self.tokens, self.starts)
        lengths = of[codes]
        before = np.cumsum(lengths) - lengths
        return lengths, flat[np.arange(int(lengths.sum())) + np.repeat(starts[codes] - before, lengths)]

    def decode(self, tokens: np.ndarray, owner: np.ndarray, owners: int) -> list[bytes]:
        """Bytes of each owner's tokens, in their order."""
        rows = pa.table({"d": owner.astype(np.int32), "p": np.arange(len(tokens)), "t": tokens.astype(np.int32)})
        self.db.register("tokens", rows)
        texts = [b""] * owners
        for d, text in self.db.execute(DECODE).fetchall():
            texts[d] = bytes.fromhex(text)
        self.db.unregister("tokens")
        return texts


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec, kept for the next tasks of the same vocabulary."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def _runs(c: Codec, texts) -> Iterator[tuple[int, list[str]]]:
    """(document, at most PIECES of its pieces), at least one run for each document; the text is never held in pieces as a whole."""
    for d, text in enumerate(texts):
        text = text.as_py() or ""
        found = (m.group() for m in c.pattern.finditer(text)) if len(text) > PIECES else iter(c.pattern.findall(text))
        run = list(islice(found, PIECES))
        yield d, run
        while run := list(islice(found, PIECES)):
            yield d, run


def _groups(runs: Iterator[tuple[int, list[str]]]) -> Iterator[list[tuple[int, list[str]]]]:
    held, n = [], 0
    for run in runs:
        held.append(run)
        n += len(run[1])
        if n >= PIECES:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, ranks: bytes, pattern: str, decoded: bool = False, text_column: str = "text") -> DataFrame:
    """Token ids of each text: doc_id, ids array<int>, and with `decoded` the bytes that the ids stand for.

    `pattern` splits the text into pieces; a piece of the vocabulary is one token, every other starts as its bytes and
    DuckDB contracts its leftmost pair of least rank until none is left. Equal pieces are contracted and their ids decoded once
    as long as the worker remembers them. `ranks` is the content of the rank file (a vocabulary, of
    bounded size), sent to each executor once. Special tokens are ordinary text. Null and empty texts have no ids; texts
    are encoded whole, in runs of PIECES; repeated rows stay; an empty table gives no rows; extra columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "doc_id bigint, ids array<int>" + (", decoded binary" if decoded else "")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for batch in stream:
            ready: list[tuple[int, list[np.ndarray], list[np.ndarray]]] = []
            for group in _groups(_runs(c, batch.column(1))):
                codes = c.encode([p for _, run in group for p in run])
                sizes = [len(run) for _, run in group]
                tokens = _per_run(*c.spread(codes), sizes)
                texts = _per_run(*c.spread(codes, decoded=True), sizes) if decoded else tokens
                for (d, _), ids, text in zip(group, tokens, texts):
                    if not ready or ready[-1][0] != d:
                        ready.append((d, [], []))
                    ready[-1][1].append(ids)
                    ready[-1][2].append(text)
                # The last document may go on in the next group.
                yield from _encoded(batch, ready[:-1], decoded)
                ready = ready[-1:]
            yield from _encoded(batch, ready, decoded)

    return source.mapInArrow(batches, schema)


def _per_run(lengths: np.ndarray, flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The values of each run of pieces."""
    ends = np.cumsum(np.append(0, lengths))[np.cumsum([0, *sizes])]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _encoded(batch: pa.RecordBatch, ready, decoded: bool) -> Iterator[pa.RecordBatch]:
    if not ready:
        return
    flat = np.concatenate([t for _, parts, _ in ready for t in parts]).astype(np.int32)
    ends = np.cumsum([0, *[sum(len(t) for t in parts) for _, parts, _ in ready]]).astype(np.int32)
    arrays = [batch.column(0).take(pa.array([d for d, _, _ in ready])), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
    names = ["doc_id", "ids"]
    if decoded:
        arrays.append(pa.array([b"".join(t.tobytes() for t in texts) for _, _, texts in ready], pa.binary()))
        names.append("decoded")
    yield pa.RecordBatch.from_arrays(arrays, names=names)


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, ids) -> (doc_id, decoded binary); null or empty ids give no bytes, an id beyond the vocabulary is an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, r"\s+")
        known = set(c.ranks.values())
        for batch in stream:
            for k in range(batch.num_rows):
                ids = np.array(batch.column(1)[k].as_py() or [], np.int64)
                if not known.issuperset(ids.tolist()):
                    raise ValueError("an id is not in the vocabulary")
                text = c.decode(ids, np.zeros(len(ids), np.int32), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array(text, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        batches, "doc_id bigint, decoded binary"
    )
