"""What several operators of this subpackage share: tables in the shared folder,
connected components and an exact memo over the tokenizers library."""

from __future__ import annotations

import codecs
import re
import tempfile
import uuid

import regex
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset (on one machine, as in tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def table(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives executors. The shuffles that made it
    are of no use afterwards, so Spark is told to remove their files with the end of the job."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def measured_table(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """``table`` and aggregates of its rows, found by the job that writes it; ``rows`` is always among them."""
    seen = Observation()
    out = table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in facts.items())), name)
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``table`` has written and that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``nodes`` (id), ``edges`` (src, dst) -> (id, component), the smallest id that
    links reach. Every round is one job: two aggregations and two joins on the node; a node
    with very many neighbours is combined before the shuffle (min) and its join
    may be split. Rounds grow with the logarithm of the longest chain; they end when the
    links' number and sums of hashes stay. Links are
    never collected. Nulls in edges and self links are ignored.
    """
    shared_folder(edges.sparkSession)
    # sums of two hashes of all links, 48 bits each, which cannot overflow a decimal
    sums = {f"h{k}": F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), "u", "v"), 16).cast("decimal(38,0)")) for k in range(2)}
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    e, before = measured_table(e, "links", **sums)
    for _ in range(max_rounds):
        if not before["rows"]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node links its lower neighbours to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new, after = measured_table(small.where("u <> v").distinct(), "links", **sums)
        discard(e)
        e, settled, before = new, after == before, after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = nodes.join(e.groupBy("u").agg(F.min("v").alias("m")), nodes["id"] == F.col("u"), "left").select("id", F.coalesce("m", "id").alias("component"))
    out.links = e  # to discard when the result is stored
    return out


def as_column(names: list[str], base: str) -> str:
    """A column name that clashes with none of ``names``."""
    name = base
    while name.lower() in {n.lower() for n in names}:
        name = f"_{name}"
    return name


#: Separators of the control kind, which Python's and the library's white space treat differently.
_ODD = re.compile("[\x1c-\x1f]")
_ODD_SIGNS = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACED = re.compile(r" \s")
_BEFORE_WORD = re.compile(r"(?= \S)")
_LINES = re.compile(r"\S+(?:\n\S+)+")
#: Signs whose classes and lower case are the same everywhere: up to U+024F, without the dotted capital I,
#: number signs that are no digits, odd separators, and what special strings begin with.
PLAIN = re.compile("[\x00-\x1b !-;=-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]*")
#: Signs that are a piece of their own behind a word.
STOPS = frozenset(".,;:!?")
BYTE_STOPS = frozenset(s.encode() for s in STOPS)
#: The pre-tokenizer patterns of the two kinds of vocabulary, and what they are for plain signs.
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN_BYTE_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN_WORD_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> str:
    """The letters that byte-level vocabularies write for the bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


class ByteBpe(dict):
    """word -> value made from the ids of a space and the word, for a byte-level BPE vocabulary.

    A text is cut before each space that a non-space follows. The pre-tokenizer
    of byte-level BPE begins a new piece exactly there and looks no further than
    one sign ahead, so the ids of the text are those of its chunks in a row. A single
    line end between non-spaces is such a place too. Of a chunk that is met first, the
    pieces are looked up in turn; the library's model encodes each piece once. A word of plain
    letters is one piece, also before a single stop, so it is looked up as a word there. Texts with special strings or odd separators and chunks
    with rare signs are left to the whole tokenizer. ``limit`` bounds the entries of
    either memo; a full one starts anew. ``value`` makes bytes or a count of a list of
    ids, and ``empty`` is that of none.
    """

    plain_pieces = _PLAIN_BYTE_PIECES

    def __init__(self, path: str, value, empty, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.value, self.empty, self.limit = value, empty, limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = (*self.special, *_ODD_SIGNS)
        self.known: dict[str, object] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def written(self, piece: str) -> str:
        """A piece as the vocabulary writes it."""
        if piece.isascii() and piece.isprintable():  # these stand for themselves, but for the space
            return piece.replace(" ", "\u0120")
        return codecs.charmap_decode(piece.encode(), "strict", self.letters)[0]

    def chunk(self, text: str):
        """The value of a text that is met as a whole."""
        if not PLAIN.fullmatch(text):
            return self.value(self.ids(text))
        return self.plain(text)

    def plain(self, text: str):
        """The same for a text of plain signs."""
        pieces = self.plain_pieces.findall(text)
        if len(pieces) == 1:  # kept as a chunk
            return self.piece_value(pieces[0])
        out = self.empty
        for piece in pieces:
            out += self.kept(piece, self.piece_value)
        return out

    def piece_value(self, piece: str):
        return self.value([t.id for t in self.model.tokenize(self.written(piece))])

    def kept(self, text: str, make):
        v = self.known.get(text)
        if v is None:
            if len(self.known) > self.limit:
                self.known.clear()
            v = self.known[text] = make(text)
        return v

    def __missing__(self, word: str):
        if word.isalpha():
            if word.isascii() or PLAIN.fullmatch(word):
                return self.keep(word, self.piece_value(" " + word))
        elif word[-1:] in STOPS and word[:-1].isalpha() and PLAIN.fullmatch(word):
            return self.keep(word, self[word[:-1]] + self.kept(word[-1], self.piece_value))
        if "\n" in word and _LINES.fullmatch(word):
            first, *rest = word.split("\n")
            v = self[first]
            for line in rest:
                v += self.kept("\n" + line, self.chunk)
            return v
        return self.keep(word, self.chunk(" " + word))

    def keep(self, word, v):
        if len(self) > self.limit:
            self.clear()
        self[word] = v
        return v

    def whole(self, text: str) -> bool:
        return any(s in text for s in self.apart)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text; joined, they are the text again."""
        if not text:
            return []
        return [text] if self.whole(text) else [c for c in _BEFORE_WORD.split(text) if c]

    def values(self, text: str) -> list:
        """The values of a text's chunks."""
        if not text or self.whole(text) or text[-1] == " " or _SPACED.search(text):
            return [self.chunk(c) for c in self.chunks(text)]
        first, *rest = text.split(" ")
        return [*([self.chunk(first)] if first else []), *map(self.__getitem__, rest)]


class WordBpe(ByteBpe):
    """word (as bytes) -> value, for vocabularies that drop white space and lower-case: a text's ids are those of
    its white-space-separated parts in a row, as no piece spans white space and neither lower-casing nor canonical
    composition reaches across it."""

    plain_pieces = _PLAIN_WORD_PIECES

    def values(self, text: str) -> list:
        return list(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))

    def __missing__(self, word: bytes):
        low = word.lower()  # of ASCII letters alone
        if low.isalpha():
            return self.keep(word, self.piece_value(low.decode()) if low == word else self[low])
        if word[-1:] in BYTE_STOPS and word[:-1].isalpha():
            return self.keep(word, self[low[:-1]] + self.kept(word[-1:].decode(), self.piece_value))
        text = word.decode()
        return self.keep(word, self.chunk(text.lower() if PLAIN.fullmatch(text) else text))


_MEMOS: dict[tuple, ByteBpe] = {}


def memo(kind: type, path: str, *args) -> ByteBpe:
    """The memo of this Python process, which tasks that follow each other share."""
    key = (kind, path, *args)
    if key not in _MEMOS:
        _MEMOS[key] = kind(path, *args)
    return _MEMOS[key]
