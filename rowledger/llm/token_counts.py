"""Exact token counts at every prefix of a text (byte-level BPE).

Method: prefix dynamic programming. The count at a prefix is the count at the
place where its last token begins, plus one; the last token is the one
vocabulary entry that ends there and stands unmerged behind the last token of
the shorter prefix. Pieces between pre-token borders do not influence each
other, so a text's table is the running sum over its pieces, and the table of a
piece is made once and looked up, as is that of a chunk of pieces. Counts, budgets and
truncation read the text's table, which is stored as a list; no text is encoded again.

Defined results: a null text counts as empty (0 bytes, 0 tokens, cut 0); ids may
be null or repeat and rows come back one for one; other columns are not read, so
their names cannot clash; an empty table gives an empty result; texts of any
length are taken whole. Special strings inside a text count as one token, as the
library's default has it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, BYTE_PIECES, ByteBpe, memo

BLOCK = 64
#: Letters up to which a prefix's table is kept for other pre-tokens.
KEPT = 5
#: Lengths of entries that any letters may end.
SHORT = (3, 2, 1)
_SPACE, _TAIL = regex.compile(r"\s*"), regex.compile(r"\s*$")
#: Two white-space signs in a row, one of them a space: what is a piece then depends on where a prefix ends.
_RUNS = re.compile(r" \s|\s ")
_DOUBLE = re.compile(r"\s\s")


class PrefixTables(ByteBpe):
    """Tables of counts at every prefix: of pieces, of chunks and of whole texts. The memo's values are the steps from
    one count to the next, 16 bits for each character."""

    def __init__(self, path: str, limit: int = 700_000):
        super().__init__(path, None, b"", limit)
        self.vocab = set(self.tokenizer.get_vocab())
        #: the lengths of entries that end with these four letters, long ones first, and those below four
        self.lengths: dict[str, tuple[int, ...]] = {}
        ends: dict[str, set[int]] = {}
        for token in self.vocab:
            if len(token) > 3:
                ends.setdefault(token[-4:], set()).add(len(token))
        self.lengths.update((end, (*sorted(n, reverse=True), *SHORT)) for end, n in ends.items())
        self.fits: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, tuple[list[int], list[str]]] = {}
        self.steps: dict[tuple[str, str], np.ndarray] = {}

    def stands(self, last: str, token: str) -> bool:
        """Whether ``last`` and ``token`` stay two tokens when they meet, or, if nothing is before it, ``token`` is one."""
        key = (last, token)
        v = self.fits.get(key)
        if v is None:
            if len(self.fits) > self.limit:
                self.fits.clear()
            v = self.fits[key] = [t.value for t in self.model.tokenize(last + token)] == ([last, token] if last else [token])
        return v

    def piece(self, text: str) -> Sequence[int]:
        """Counts at each character prefix of one pre-token, the empty one first. What a prefix has is kept for all pre-tokens
        that begin so; the table goes on from the longest one that is known."""
        s, known, vocab, fits, lengths = self.written(text), self.prefixes, self.vocab, self.fits, self.lengths
        n = len(s)
        k = min(n, KEPT)
        while k and (found := known.get(s[:k])) is None:
            k -= 1
        counts, lasts = map(list, found) if k else ([0], [""])
        for i in range(k + 1, n + 1):
            for length in lengths.get(s[i - 4 : i], SHORT) if i > 3 else SHORT:
                j = i - length
                if j >= 0 and (token := s[j:i]) in vocab:
                    fit = fits.get((lasts[j], token))
                    if self.stands(lasts[j], token) if fit is None else fit:
                        break
            counts.append(counts[j] + 1)
            lasts.append(token)
        if k < min(n, KEPT):
            if len(known) > self.limit:
                known.clear()
            for i in range(k + 1, min(n, KEPT) + 1):
                known[s[:i]] = (counts[: i + 1], lasts[: i + 1])
        if n == len(text):
            return counts
        return [counts[e] for e in accumulate((len(c.encode()) for c in text), initial=0)]

    def begun(self, piece: str) -> Sequence[int]:
        """The counts of a piece within a text: a contraction that has begun is still a sign and a letter."""
        t = self.piece(piece)
        return [0, 1, 2, t[3]] if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha() else t

    def piece_value(self, piece: str) -> bytes:
        t = self.begun(piece)
        return array("h", map(sub, t[1:], t)).tobytes()

    def chunk(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and not _DOUBLE.search(text):
            return self.plain(text)
        return np.diff(self.table(text)).astype(np.int16).tobytes()

    def table(self, text: str) -> np.ndarray:
        """Counts at each character prefix of a text: len(text) + 1 numbers. A special string is one token once it is complete;
        before that its beginning is ordinary text."""
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        out, base, t = [0], 0, [0]
        for i, part in enumerate(parts):
            if i % 2:
                before = parts[i - 1]
                out += [base - t[-1] + c for c in self.ordinary(before + part[:-1])[len(before) + 1 :]]
                base += 1
                out.append(base)
            else:
                t = self.ordinary(part)
                out += [base + c for c in t[1:]]
                base += t[-1]
        return np.array(out)

    def ordinary(self, text: str) -> list[int]:
        """The same for a text without special strings."""
        out, base, run, at_run = [0], 0, "", 0
        for m in BYTE_PIECES.finditer(text):
            piece = m[0]
            t = self.begun(piece)
            inner = [base + c for c in t[1:]]
            lead = _SPACE.match(piece).end()
            if run and lead:  # a prefix that ends in white space ends in one piece of it
                whole = self.piece(run + piece[:lead])
                inner[:lead] = [at_run + c for c in whole[len(run) + 1 :]]
            if lead == len(piece):
                run, at_run = (run + piece, at_run) if run else (piece, base)
            else:
                run = ""
            out += inner
            base += t[-1]
        return out

    @staticmethod
    def cut(counts: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix that has no more than ``budget`` tokens, from a text's table."""
        return int(np.flatnonzero(counts <= budget).max(initial=0))

    def step(self, tail: str, chunk: str) -> np.ndarray:
        """Counts at each character of a chunk beyond those before it; ``tail``: the white space that it follows, if any."""
        key = (tail, chunk)
        t = self.steps.get(key)
        if t is None:
            if len(self.steps) > self.limit:
                self.steps.clear()
            t = self.table(tail + chunk)[len(tail) + 1 :] - (int(self.table(tail)[-1]) if tail else 0)
            t = self.steps[key] = t.astype(np.int32)
        return t

    def counts(self, text: str) -> np.ndarray:
        """The same as ``table``, from the tables of the text's chunks."""
        if not text or self.whole(text):
            return self.table(text).astype(np.int32)
        if text[-1] != " " and not _RUNS.search(text):  # no chunk's table depends on what is before it
            out = np.zeros(len(text) + 1, np.int32)
            np.cumsum(np.frombuffer(b"".join(self.values(text)), np.int16), out=out[1:])
            return out
        chunks, tail, made = self.chunks(text), "", []
        for c in chunks:
            made.append(self.step(tail, c))
            tail = _TAIL.search(c)[0] if c[-1].isspace() else ""
        base = np.cumsum([0, *(t[-1] for t in made[:-1])], dtype=np.int32)
        out = np.zeros(len(text) + 1, np.int32)
        out[1:] = np.concatenate(made) + np.repeat(base, [len(t) for t in made])
        return out


def prefix_counts(docs: DataFrame, tokenizer: str, budgets: tuple[int, ...] = (512,), id_col: str = "doc_id", text_col: str = "text", with_table: bool = False) -> DataFrame:
    """One row per row: the id, n_bytes, n_tokens, cut_<budget> (characters of the longest
    prefix within the budget) and, if asked for, prefix_tokens: the count at every prefix. All are read from the text's table.

    One scan of two columns, no shuffle. Memory per task: a memo of ``limit`` pieces and one block of texts."""
    names = ["n_bytes", "n_tokens", *(f"cut_{b}" for b in budgets), *["prefix_tokens"] * with_table]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = memo(PrefixTables, tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = [t or "" for t in part.column(1).to_pylist()]
                made = [tables.counts(t) for t in texts]
                cols = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([int(t[-1]) for t in made], pa.int64())]
                cols += [pa.array([tables.cut(t, b) for t in made], pa.int64()) for b in budgets]
                if with_table:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate(made))))
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    out = ", ".join(["id " + kind, "n_bytes long", "n_tokens long", *(f"cut_{b} long" for b in budgets), *["prefix_tokens array<int>"] * with_table])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def within_budget(counts: DataFrame, budget: int) -> DataFrame:
    """Adds over_limit from stored counts; no text is read."""
    return counts.withColumn("over_limit", F.col("n_tokens") > budget)


def truncate(docs: DataFrame, tokenizer: str, budget: int, text_col: str = "text") -> DataFrame:
    """The rows with their texts cut to the longest prefix of at most ``budget`` tokens, read from each text's own table in one pass.

    No row is lost or met with another: ids may be null or repeated, null texts stay null, other columns are kept as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = memo(PrefixTables, tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                cols = list(part.columns)
                cols[at] = pa.array([None if t is None else t[: tables.cut(tables.counts(t), budget)] for t in cols[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
