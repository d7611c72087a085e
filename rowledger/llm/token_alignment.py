"""Alignment of two tokenizers over the same texts, by lockstep vectorised merging.

Each text, with a space in front, is encoded by a byte-level vocabulary (A) and by a
piece vocabulary (B). A token ends at a byte of the text; where tokens of both end, the
text is cut, and the two tokens that end there are linked. All documents of a batch
advance at once: one state vector has a pair of pointers (next A token, next B token) for
each; a step compares the ends under the pointers, emits links and cuts where they are
equal, moves the pointer of the smaller end (both, if equal), and drops those that are
finished. A text longer than ``LANE`` bytes has a pair of pointers for each such stretch
of it, so the number of steps does not grow with the longest text.

One pass encodes, merges and stores the links of each document as packed ids. Pairs are
then counted over the corpus, inside tasks first. The ``few`` most frequent pairs, a
bounded number, go to all tasks with their counts; links of other pairs are joined with
the table of counts, so nothing is cut off.

Chunks: where a single space stands between two others than spaces, both vocabularies
begin a new token, so chunks between such places are encoded once in a process. (No piece
of B holds a space behind another sign, which is checked when it is loaded; else whole
texts are encoded.)

Defined results: null and empty texts, and texts whose joined tokens differ from the text,
have no tokens: zeros and an empty list of groups; repeated rows count as often as they
occur; ids may be null; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, _SPACED, byte_letters, discard, memo, table
from .token_files import pack_ids

#: Bytes of text that are merged together, and that one pair of pointers walks at most.
BATCH, LANE = 4 << 20, 2048
#: Pairs whose counts are sent to all tasks, 16 bytes each.
FEW_PAIRS = 1_000_000
#: Pairs that a task holds before it passes on what it has counted.
HELD = 2_000_000

_BOUNDARY = re.compile(r"(?<=[^ ])(?= \S)")


class TwoTokenizers(dict):
    """word -> (A ids, B ids) of a space and the word, packed. The words of a text that are met first are encoded together,
    as one text, and told apart by where they end. ``limit`` bounds the entries; a full memo starts anew."""

    def __init__(self, byte_path: str, piece_path: str, limit: int = 400_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = SentencePieceProcessor(model_file=piece_path)
        self.limit = limit
        code = {ord(c): b for b, c in enumerate(byte_letters())}
        names = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            a_bytes[i] = bytes(code[ord(c)] for c in name) if all(ord(c) in code for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.bytes, self.length = (a_bytes, b_bytes), [np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes)]
        self.by_chunks = self.a.normalizer is None and not any(re.search("[^▁]▁", p) for p in pieces)

    def whole(self, text: str) -> list[list[int]]:
        return [self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)]

    def same(self, ids: list[list[int]], text: str) -> bool:
        """Whether the tokens of both, joined, are a space and the text."""
        raw = (" " + text).encode()
        return all(b"".join([t[i] for i in x]) == raw for t, x in zip(self.bytes, ids, strict=True))

    def learn(self, words: list[str]) -> bool:
        """False if one of the words is not given back by its tokens; then nothing is learned."""
        text = " ".join(words)
        both = self.whole(text)
        if not self.same(both, text):
            return False
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        parts = []
        for ids, length in zip(both, self.length, strict=True):
            ids = np.array(ids, "<u4")
            token_ends = np.cumsum(length[ids])
            at = np.searchsorted(token_ends, ends)
            if not np.array_equal(token_ends[at], ends):
                raise ValueError("a token reaches across a space")
            raw = ids.tobytes()
            parts.append([raw[4 * i : 4 * j + 4] for i, j in zip([0, *(at[:-1] + 1).tolist()], at.tolist(), strict=True)])
        self.update(zip(words, zip(*parts, strict=True), strict=True))
        return True

    def pair(self, text: str) -> tuple[bytes, bytes]:
        """Packed ids of both; none for a text that either does not give back."""
        if not text:
            return b"", b""
        if self.by_chunks and "▁" not in text and not _ODD.search(text):
            if text[0] == " " or text[-1] == " " or _SPACED.search(text):
                words = [c[1:] for c in _BOUNDARY.split(" " + text)]
            else:
                words = text.split(" ")
            if len(self) > self.limit:
                self.clear()
            fresh = {w: None for w in words if w not in self}
            # what begins or ends with a space is met at the ends of a text only, and is encoded alone
            alone = [w for w in fresh if w[:1] in ("", " ") or w[-1] == " "]
            for w in alone:
                del fresh[w]
            if all(self.learn([w]) for w in alone) and (not fresh or self.learn(list(fresh))):
                found = [self[w] for w in words]
                return b"".join([x[0] for x in found]), b"".join([x[1] for x in found])
        ids = self.whole(text)
        return (pack_ids(ids[0]), pack_ids(ids[1])) if self.same(ids, text) else (b"", b"")


def merge(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of A tokens, places of B tokens) of a batch. ``ends_a``, ``ends_b``: where the tokens end, over all
    documents in a row; ``starts``, ``ends``: the bytes of each document."""
    lanes = np.maximum(1, -(-(ends - starts) // LANE))
    first = np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = np.repeat(starts, lanes) + LANE * (np.arange(lanes.sum()) - first)
    to = np.minimum(at + LANE, np.repeat(ends, lanes))
    a, b = np.searchsorted(ends_a, at, "right"), np.searchsorted(ends_b, at, "right")
    last_a, last_b = np.searchsorted(ends_a, to, "right"), np.searchsorted(ends_b, to, "right")
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while True:
        going = np.flatnonzero((a < last_a) & (b < last_b))
        if len(going) < len(a):
            a, b, last_a, last_b = a[going], b[going], last_a[going], last_b[going]
        if not len(a):
            break
        x, y = ends_a[a], ends_b[b]
        both = x == y
        out_a.append(a[both])
        out_b.append(b[both])
        a, b = a + (x <= y), b + (y <= x)
    # links of one document keep their order; A's places and B's rise together
    return np.sort(np.concatenate(out_a)), np.sort(np.concatenate(out_b))


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0..n-1, without leading zeros, which are 0 bytes."""
    width = len(str(max(1, n - 1)))
    powers = 10 ** np.arange(width)[::-1]
    ids = np.arange(n)[:, None]
    return np.where((ids >= powers) | (powers == 1), ids // powers % 10 + 48, 0).astype(np.uint8)


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, documents: np.ndarray, digits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;...`` of all documents in a row and where each one's ends. ``cut_a``, ``cut_b``: places of the last tokens of
    the groups; ``documents``: number of groups of each document."""
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    width = digits.shape[1]
    out = np.zeros((len(ids_a) + len(ids_b), width + 1), np.uint8)
    place_a = np.arange(len(ids_a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)
    place_b = np.arange(len(ids_b)) + np.repeat(np.cumsum(size_a), size_b)
    out[place_a, :width], out[place_b, :width] = digits[ids_a], digits[ids_b]
    out[:, width] = ord(",")
    out[place_a[cut_a], width], out[place_b[cut_b], width] = ord("|"), ord(";")
    group_ends = np.cumsum(documents)
    full = documents > 0
    out[place_b[cut_b[group_ends[full] - 1]], width] = 0
    filled = out != 0
    token_ends = np.concatenate([[0], np.cumsum(filled.sum(1))])
    last = np.concatenate([[0], place_b[cut_b] + 1])[group_ends]
    return out[filled].tobytes(), token_ends[last]


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", groups: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups, link_a, link_b): one scan. ``groups`` as text or its ``sha256``; ``link_a``, ``link_b``:
    the ids linked at each cut in the order of the text, little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(TwoTokenizers, byte_path, piece_path)
        digits = _digits(max(len(known.bytes[0]), len(known.bytes[1])))

        def done(ids: list, pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            n_a, n_b = (np.array([len(p[k]) // 4 for p in pairs], np.int64) for k in range(2))
            a, b = (np.frombuffer(b"".join([p[k] for p in pairs]), "<u4") for k in range(2))
            ends_a, ends_b = np.cumsum(known.length[0][a]), np.cumsum(known.length[1][b])
            ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
            starts = np.concatenate([[0], ends[:-1]])
            some = n_a > 0
            at_a, at_b = merge(ends_a, ends_b, starts[some], ends[some])
            upto = np.searchsorted(at_a, np.cumsum(n_a))
            n = np.diff(upto, prepend=0)
            text, text_ends = group_texts(a, b, at_a, at_b, n, digits)
            texts = [text[i:j] for i, j in zip([0, *text_ends[:-1]], text_ends, strict=True)]
            if groups == "sha256":
                texts = [hashlib.sha256(t).hexdigest().encode() if t else b"" for t in texts]
            offsets = pa.py_buffer(np.concatenate([[0], 4 * upto]).astype(np.int32))
            links = [pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(x.astype("<u4").tobytes())]) for x in (a[at_a], b[at_b])]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n)), pa.array(texts, pa.binary()).cast(pa.string()), *links], ["id", "n_a", "n_b", "n_groups", "groups", "link_a", "link_b"])

        for batch in batches:
            ids, pairs, held = [], [], 0
            texts = batch.column(1)
            for k in range(batch.num_rows):
                pair = known.pair(texts[k].as_py() or "")
                ids.append(batch.column(0).slice(k, 1))
                pairs.append(pair)
                held += len(pair[0]) + 64
                if held > BATCH:
                    yield done(ids, pairs)
                    ids, pairs, held = [], [], 0
            if ids:
                yield done(ids, pairs)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, groups string, link_a binary, link_b binary")


def _keys(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """The links of a document as numbers."""
    return np.frombuffer(a[k].as_py(), "<u4").astype(np.int64) << 32 | np.frombuffer(b[k].as_py(), "<u4")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each pair (A's id in the upper 32 bits, B's in the lower), and whether no pair of
    its B id has more. Counted inside tasks, then one shuffle of what they have counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh, waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                fresh.append(_keys(batch.column(0), batch.column(1), k))
                waiting += len(fresh[-1])
                if waiting > HELD:
                    keys, counts = _added(keys, counts, fresh)
                    fresh, waiting = [], 0
                    if len(keys) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                        keys, counts = keys[:0], counts[:0]
        keys, counts = _added(keys, counts, fresh)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    n = aligned.select("link_a", "link_b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = table(n, "pairs")
    of_b = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")
    # one row for each id of B: the size of its vocabulary bounds them
    most = n.groupBy(of_b).agg(F.max("n").alias("most"))
    out = table(n.withColumn("b", of_b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")
    discard(n)
    return out


def _added(keys: np.ndarray, counts: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(np.concatenate([np.empty(0, np.int64), *fresh]), return_counts=True)
    if not len(keys):
        return new, n
    both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
    total = np.zeros(len(both), np.int64)
    np.add.at(total, at, np.concatenate([counts, n]))
    return both, total


def _frequent(counts: DataFrame, few: int) -> list[np.ndarray]:
    """Pairs, counts and marks of the pairs above the lowest count that at most ``few`` pairs reach."""
    # counts by their two leading binary digits: some 120 rows
    step = F.floor(F.log2(F.col("n").cast("double")) * 2).cast("int")
    bins = sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["s"])
    total, lowest = 0, None
    for r in bins:
        total += r["c"]
        if total > few:
            break
        lowest = r["s"]
    rows = counts.where(step >= lowest).toArrow() if lowest is not None else counts.limit(0).toArrow()
    order = np.argsort(rows["pair"].to_numpy())
    return [rows[c].to_numpy()[order] for c in ("pair", "n", "best")]


def with_counts(aligned: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """Adds n_links, n_best (links whose count is the highest of their B id) and count_sum to ``align``'s rows, without the links."""
    spark = aligned.sparkSession
    stored = table(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = pair_counts(stored)
    sent = spark.sparkContext.broadcast(_frequent(counts, few))
    kind = stored.schema["id"].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "groups", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                keys = [_keys(rows.column(6), rows.column(7), k) for k in range(rows.num_rows)]
                size = np.array([len(k) for k in keys], np.int64)
                doc, key = np.repeat(np.arange(len(keys)), size), np.concatenate([np.empty(0, np.int64), *keys])
                place = np.searchsorted(pairs, key)
                known = place < len(pairs)
                known[known] = pairs[place[known]] == key[known]
                place, others = place[known], ~known
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, doc[known], n[place])
                bests = np.bincount(doc[known], best[place].astype(float), len(keys)).astype(np.int64)
                rest_at = np.concatenate([[0], np.cumsum(np.bincount(doc[others], minlength=len(keys)))])
                rest = pa.ListArray.from_arrays(pa.array(rest_at, pa.int32()), pa.array(key[others]))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(6)), pa.array(size), pa.array(bests), pa.array(sums), rest], [*names, "n_links", "n_best", "count_sum", "rest"])

    cols = f"id {kind}, n_a long, n_b long, n_groups long, groups string, row long, n_links long, n_best long, count_sum long"
    out = stored.select(*names, "link_a", "link_b").mapInArrow(run, f"{cols}, rest array<long>")
    if counts.count() > len(sent.value[0]):
        out = table(out, "counted")
        rare = out.where(F.size("rest") > 0).select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("k"))
        more = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("b"), F.sum(F.col("k") * F.col("n")).alias("s"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))})
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
