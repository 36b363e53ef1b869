"""Encoding of a corpus with a public byte-level BPE, by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap. Each chunk is pre-tokenised by
itself; where the pre-token boundaries of two neighbours meet inside their overlap they have
resynchronised, and there the text is cut for good. The pieces are then encoded one by one and
their ids joined. Texts beyond ``split_chars`` are cut in the same way into rows of their own, so
that several tasks share one text. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pre-token pattern of the public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
SPLIT_CHARS = 1_000_000
#: Boundaries this near to the end of a chunk may depend on what follows it.
_TAIL = 8


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabularies of this machine lie."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


@functools.lru_cache(maxsize=4)
def _encoding(digest: str, data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding(digest, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def boundaries(text: str, start: int, end: int) -> list[int]:
    """Where pre-tokens begin in ``text[start:end]``, pre-tokenised on its own; positions in ``text``."""
    return [start + m.start() for m in _pattern().finditer(text[start:end])]


def _meeting(left: list[int], right: list[int], text: str, lo: int, hi: int) -> int:
    """First position in [lo, hi) where both have a boundary that doesn't hang on the following text; -1 if none."""
    common = set(right)
    for b in left:
        if lo <= b < hi and b in common and not text[b - 1].isspace():
            return b
    return -1


def cut_points(text: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Positions at which ``text`` falls into pieces that encode on their own, 0 and the length included.

    A chunk pair without a common boundary (one very long run of letters or white space) is taken
    together; after each failure the next attempt is twice as far away.
    """
    n, cuts = len(text), [0]
    at, ahead = chunk_chars, 1
    bounds = boundaries(text, 0, min(n, chunk_chars + overlap))
    while at < n:
        end = min(n, at + chunk_chars + overlap)
        right = boundaries(text, at, end)
        cut = _meeting(bounds, right, text, at + 1, min(n, at + overlap) - _TAIL)
        if cut > 0:
            cuts.append(cut)
            bounds, ahead = right, 1
            at += chunk_chars
        else:
            ahead *= 2
            at += chunk_chars * ahead
            if at < n:
                bounds = boundaries(text, cuts[-1], min(n, at + overlap))
    return [*cuts, n]


def encode_text(enc: tiktoken.Encoding, text: str | None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Token ids of one text, special strings being ordinary text; null and empty give an empty list."""
    if not text:
        return []
    if len(text) <= chunk_chars:
        return enc.encode_ordinary(text)
    cuts = cut_points(text, chunk_chars, overlap)
    out: list[int] = []
    for a, b in zip(cuts, cuts[1:]):
        out += enc.encode_ordinary(text[a:b])
    return out


def decode_ids(enc: tiktoken.Encoding, ids: list[int]) -> str:
    """The text of a list of ids: the raw bytes of all of them, joined, then read as UTF-8."""
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8", errors="replace")


def load_encoding(path: str | None = None) -> tiktoken.Encoding:
    data = Path(path or vocabulary_path()).read_bytes()
    return _encoding(hashlib.sha256(data).hexdigest(), data)


def _id_lists(enc: tiktoken.Encoding, texts: pa.Array, chunk_chars: int, overlap: int) -> pa.Array:
    """The ids of a batch of texts as one Arrow column; each text's ids shrink to four bytes at once."""
    lists = [np.array(encode_text(enc, t.as_py(), chunk_chars, overlap), np.int32) for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)])))


def _pieces_of_long(long: DataFrame, id_col: str, text_col: str, split_chars: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Cuts very long texts into rows: (id, piece number, piece), and the ids whose chunks nowhere meet."""
    n = F.length(text_col)
    chunks = long.select(
        F.col(id_col).alias("id"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(n / split_chars).cast("int") - 1), lambda i: F.substring(F.col(text_col), i * split_chars + 1, F.lit(split_chars + overlap)))).alias("no", "chunk"),
    )
    schema = T.StructType([T.StructField("id", long.schema[id_col].dataType), T.StructField("no", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("head", T.ArrayType(T.IntegerType())), T.StructField("tail", T.ArrayType(T.IntegerType()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail = [], []
            for text in batch.column(2).to_pylist():
                # the head's boundaries count from the chunk's start, the tail's from the start of the next chunk
                at = boundaries(text, 0, len(text))
                head.append([b for b in at if 0 < b < min(len(text), overlap) - _TAIL and not text[b - 1].isspace()])
                tail.append([b - split_chars for b in at if split_chars < b < len(text) - _TAIL and not text[b - 1].isspace()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], schema.names)

    marked = chunks.repartition("id", "no").mapInArrow(index, schema)
    w = Window.partitionBy("id").orderBy("no")
    cuts = marked.withColumn("begin", F.when(F.col("no") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(w))))).withColumn("last", F.lead("no").over(w).isNull()).withColumn("finish", F.lead("begin").over(w) + split_chars)
    whole = Window.partitionBy("id")
    cuts = cuts.withColumn("met", F.min(F.col("begin").isNotNull()).over(whole))
    pieces = cuts.filter("met").select("id", "no", F.expr("substring(chunk, begin + 1, if(last, length(chunk), finish - begin))").alias("piece"))
    return pieces, cuts.filter("not met").select("id").distinct()


def encode_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    split_chars: int = SPLIT_CHARS,
    length_col: str | None = None,
) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row.

    Null and empty texts get an empty list; strings that look like special tokens are ordinary
    text; repeated rows and ids (null ones too) come out repeatedly, each with its own text's ids;
    other columns are dropped. ``length_col`` may name a column with the
    text's length: its statistics then let the scan for very long texts skip most files. A very
    long text whose chunks nowhere meet is encoded within one task.
    """
    if overlap <= 2 * _TAIL or chunk_chars <= overlap or split_chars <= overlap:
        raise ValueError("overlap must be larger than 16 and smaller than the chunks")
    spark = df.sparkSession
    vocab = spark.sparkContext.broadcast(Path(vocabulary or vocabulary_path()).read_bytes())
    out_type = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encoder() -> tiktoken.Encoding:
        data = vocab.value
        return _encoding(hashlib.sha256(data).hexdigest(), data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists(enc, batch.column(1), chunk_chars, overlap)], out_type.names)

    def run_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _id_lists(enc, batch.column(2), chunk_chars, overlap)], ["id", "no", "ids"])

    is_long = F.coalesce((F.col(length_col) if length_col else F.length(text_col)) > split_chars, F.lit(False))
    rows = df.select(id_col, text_col, is_long.alias("__long"))
    if length_col:
        rows = df.filter(~is_long).select(id_col, text_col)
        long = df.filter(F.col(length_col) > split_chars).select(id_col, text_col).filter(F.length(text_col) > 0)
        spare = df.filter(F.col(length_col) > split_chars).select(id_col, text_col).filter(F.coalesce(F.length(text_col), F.lit(0)) == 0)
        rows = rows.unionByName(spare)
    else:
        rows, long = rows.filter(~F.col("__long")).select(id_col, text_col), rows.filter("__long").select(id_col, text_col)
    short = rows.mapInArrow(run, out_type)
    # ids needn't be unique: a long text's pieces are known by id and text, its copies by their number
    long = long.groupBy(id_col, text_col).agg(F.count("*").alias("__n")).select(F.struct(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("hash"), F.col("__n").cast("int").alias("copies")).alias("__key"), text_col)
    pieces, unmet = _pieces_of_long(long, "__key", text_col, split_chars, overlap)
    piece_type = T.StructType([T.StructField("id", long.schema["__key"].dataType), T.StructField("no", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    joined = (
        pieces.mapInArrow(run_pieces, piece_type)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
        .select(F.col("id.id").alias(id_col), F.flatten(F.col("parts.ids")).alias("ids"), F.explode(F.array_repeat(F.lit(0), F.col("id.copies"))).alias("__copy"))
        .drop("__copy")
    )
    alike = long.join(unmet, F.col("__key").eqNullSafe(F.col("id")), "left_semi")
    rest = alike.select(F.col("__key.id").alias(id_col), text_col, F.explode(F.array_repeat(F.lit(0), F.col("__key.copies"))).alias("__copy")).drop("__copy").mapInArrow(run, out_type)
    return short.unionByName(joined).unionByName(rest)
