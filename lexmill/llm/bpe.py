"""BPE encoding and decoding through a distinct-word table.

Encoding, three steps:

1. Split. Every partition cuts its texts into words at ASCII white space and numbers the distinct words of
   each chunk (whole texts, about ``CHUNK_WORDS`` words) by frequency. It keeps
   each text as the numbers of its words, by position, and deals the chunk's distinct words to buckets by
   their hash. That table is checkpointed: the later steps read what one run has written.
2. Encode. A bucket gets each word at most once from a chunk (a frequent word is pre-aggregated, so no word
   is hot), finds the distinct ones and encodes each of them once with the tokenizers library.
3. Join back. A chunk's words meet their ids again and every text becomes its ids, by position.

Why words may be encoded alone: the tokenizer drops white space, and neither its normaliser nor its split
pattern nor a special token reaches across ASCII white space. ASCII case and a trailing run of ``.`` and ``,``
after an ASCII letter or digit are split off first (texts with ``<|`` excepted, for special tokens are
matched as written), which makes the word table smaller and changes no id.

Decoding joins every id to its piece: a broadcast join. The id-to-piece table has one row for each id of the vocabulary
(49,408 here), a size that doesn't depend on the data, so it is sent to every task; its keys are 0, 1, 2 and so on, so the
join's hash table is an array that a text's ids are looked up in, in order.

Memory: no task runs more than one Python worker. :func:`bpe_decode` over :func:`bpe_encode` would run two at once, the
join's and the decoder's, and executors keep all their workers; :func:`bpe_round_trip` runs both steps in one. Each step
gives back what it has freed, for the same workers serve all of them.

Defined results: a null text is an empty one; an empty text has no ids and decodes to ""; repeated rows and
null ids are rows like any other; an id outside the vocabulary decodes to nothing; other columns of the
input, whatever their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, text_bytes, trim

CHUNK_WORDS = 3_000_000
ROW_WORDS = 400_000
ROW_DOCS = 4_000
#: Bytes of distinct words that a bucket holds, about; they take up a tenth of the texts or less.
BUCKET = 16 << 20
#: The tokenizer's parts for which words can be encoded alone.
NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}

_TAIL = re.compile(rb"(?<=[a-z0-9])([.,]+)(?=[ \t\n\r\x0b\x0c]|\Z)")


def tokenizer_json(path: str) -> str:
    """The tokenizer's file, checked to be of the kind whose words can be encoded alone."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    norm = spec.get("normalizer") or {}
    kinds = {n["type"] for n in norm.get("normalizers", [norm] if norm else [])}
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    if spec["model"]["type"] != "BPE" or not drops or "Lowercase" not in kinds or kinds - NORMALIZERS:
        raise ValueError("the tokenizer must be a lower-casing BPE whose pre-tokenizer drops white space")
    if spec.get("decoder") is not None or spec.get("post_processor") is not None:
        raise ValueError("tokenizers with a decoder or a post-processor are not supported")
    return text


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, as the word table has them."""
    if b"<|" in text:
        return text.split()
    return _TAIL.sub(rb" \1", text.lower()).split()


def _pack(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(a: np.ndarray) -> bytes:
    """Numbers of which most are below 255: a byte each, and the planes of the others."""
    small = zstandard.ZstdCompressor(level=3).compress(np.minimum(a, 255).astype(np.uint8).tobytes())
    return len(small).to_bytes(4, "little") + small + _pack(a[a >= 255] - 255)


def _unpack_words(b: bytes) -> np.ndarray:
    cut = 4 + int.from_bytes(b[:4], "little")
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:cut]), np.uint8).astype(np.uint32)
    a[a == 255] = _unpack(b[cut:]) + 255
    return a


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _splitter(n_buckets: int):
    def split(batches):
        task, seq = TaskContext.get().partitionId(), 0
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("body", pa.binary())])
        numbers = _Numbers()
        ids: list = []
        parts: list = []
        held = 0

        def row(kind, bucket, ids, lens, body):
            return pa.RecordBatch.from_pylist([{"chunk": task * 2**24 + seq, "kind": kind, "bucket": bucket, "ids": ids, "lens": lens, "body": body}], schema)

        def chunk():
            """The texts as word numbers, the most frequent word first; each word's bucket; each bucket's words."""
            lens = np.array([len(p) for p in parts], np.uint32)
            flat = np.concatenate(parts)
            parts.clear()
            counts = sum(np.bincount(flat[i : i + ROW_WORDS], minlength=len(numbers)) for i in range(0, max(1, len(flat)), ROW_WORDS))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            ends = np.cumsum(lens, dtype=np.int64)
            at = 0
            while at < len(ids):
                first = int(ends[at - 1]) if at else 0
                to = min(at + ROW_DOCS, int(np.searchsorted(ends, first + ROW_WORDS)) + 1, len(ids))
                yield row(0, -1, ids[at:to], _pack(lens[at:to]), _pack_words(rank[flat[first : int(ends[to - 1])]]))
                at = to
            del flat
            words = list(numbers)
            words = [words[i] for i in order.tolist()]
            of = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % n_buckets
            yield row(1, -1, [], b"", _pack(of))
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=n_buckets))
            for k in np.unique(of).tolist():
                picked = [words[i] for i in order[ends[k - 1] if k else 0 : ends[k]].tolist()]
                yield row(2, k, [], b"", zstandard.ZstdCompressor(level=9).compress(b"\n".join(picked)))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py() or b"")
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                ids.append(doc)
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield from chunk()
                    numbers, ids, held, seq = _Numbers(), [], 0, seq + 1
                    trim()
        if ids:
            yield from chunk()
            numbers = _Numbers()
            trim()

    return split


def _encoder(spec):
    def encode(t: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec.value)
        numbers = _Numbers()
        lists = []
        for body in t.column("body"):
            words = zstandard.ZstdDecompressor().decompress(body.as_py()).split(b"\n")
            lists.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
        distinct = [w.decode("utf-8", "replace") for w in numbers]
        lens, flat = np.zeros(len(distinct), np.uint32), []
        for at in range(0, len(distinct), 8192):
            got = [e.ids for e in tok.encode_batch(distinct[at : at + 8192], add_special_tokens=False)]
            lens[at : at + len(got)] = [len(x) for x in got]
            flat.append(np.fromiter((i for x in got for i in x), np.uint32))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        starts = np.cumsum(lens, dtype=np.int64) - lens
        out_lens, out_ids = [], []
        for words in lists:
            n = lens[words]
            out_lens.append(_pack(n))
            out_ids.append(_pack(flat[_ranges(starts[words], n)]))
        del numbers, distinct, lists, flat
        trim()
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "lens": pa.array(out_lens, pa.binary()), "body": pa.array(out_ids, pa.binary())})

    return encode


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lens[0] numbers), then the same of the next."""
    lens = lens.astype(np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(int(lens.sum()), dtype=np.int64)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_DECODED = pa.schema([*_ENCODED, ("decoded", pa.string())])


def _joined(texts: pa.Table, coded: pa.Table):
    """Batches of ``doc_id`` and ``ids``: a chunk's texts, with what its words were encoded as."""
    kinds = texts.column("kind").to_numpy()
    bodies = texts.column("body")
    of = _unpack(bodies[int(np.flatnonzero(kinds == 1)[0])].as_py())
    order = np.argsort(of, kind="stable")  # the words, bucket by bucket, as the encoder returns them
    lens = np.zeros(len(of), np.uint32)
    by_bucket = sorted(range(coded.num_rows), key=lambda i: coded.column("bucket")[i].as_py())
    got = [_unpack(coded.column("lens")[i].as_py()) for i in by_bucket]
    flat = np.concatenate([_unpack(coded.column("body")[i].as_py()) for i in by_bucket] or [np.zeros(0, np.uint32)])
    lens[order] = np.concatenate(got) if got else 0
    starts = np.zeros(len(of), np.int64)
    starts[order] = np.cumsum(lens[order], dtype=np.int64) - lens[order]
    for r in np.flatnonzero(kinds == 0).tolist():
        ids, counts, words = texts.column("ids")[r], _unpack(texts.column("lens")[r].as_py()), _unpack_words(bodies[r].as_py())
        n = lens[words]
        tokens = flat[_ranges(starts[words], n)].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[np.cumsum(counts, dtype=np.int64)] * 4
        at = [0, *ends.tolist()]
        yield pa.record_batch({"doc_id": ids.values, "ids": pa.array([tokens[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())})
        trim()


def _joiner(texts: pa.Table, coded: pa.Table) -> pa.Table:
    return pa.Table.from_batches(_joined(texts, coded), _ENCODED)


def _decoder(pieces):
    """Batches of ``doc_id``, ``ids`` and ``decoded`` from such of ``doc_id`` and ``ids``."""

    def decode(batches):
        table = np.array([*pieces.value, None], object)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for ids in part.column(1):
                    ids = np.frombuffer(ids.as_py() or b"", "<u4")
                    got = table[np.minimum(ids, len(table) - 1)].tolist()
                    out.append(" ".join(got) if None not in got else " ".join(p for p in got if p is not None))
                yield pa.record_batch({"doc_id": part.column(0), "ids": part.column(1), "decoded": pa.array(out, pa.string())})

    return decode


def _pieces(df: DataFrame, tokenizer_path: str):
    """The id-to-piece table, sent to every task."""
    spec = json.loads(tokenizer_json(tokenizer_path))
    by_id = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return df.sparkSession.sparkContext.broadcast([by_id.get(i) for i in range(max(by_id) + 1)])


def bpe_encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every row: the token ids as little-endian unsigned 32-bit integers.

    ``n_buckets`` deals out the distinct words; by default as many as keep a bucket at ``BUCKET`` bytes however large the
    corpus is, and the session's shuffle width at least.
    """
    return _chunks(df, tokenizer_path, id_col, text_col, n_buckets).applyInArrow(_joiner, "doc_id long, ids binary")


def _chunks(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, n_buckets: int | None):
    """Each chunk's texts and encoded words, brought together."""
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    n_buckets = n_buckets or max(partitions(spark), -(-text_bytes(rows) // (10 * BUCKET)))
    split = materialize(rows.mapInArrow(_splitter(n_buckets), "chunk long, kind int, bucket int, ids array<long>, lens binary, body binary"))
    coded = (
        split.where("kind = 2").select("chunk", "bucket", "body").groupBy("bucket")
        .applyInArrow(_encoder(spec), "chunk long, bucket int, lens binary, body binary")
    )
    texts = split.where("kind < 2").drop("bucket")
    return texts.groupBy("chunk").cogroup(coded.groupBy("chunk"))


def bpe_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``: the pieces of a row's ids, space-joined, special tokens included."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decoder(_pieces(df, tokenizer_path)), "doc_id long, ids binary, decoded string")


def bpe_round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """:func:`bpe_decode` of :func:`bpe_encode`: the same steps, the decoder in the worker that joins a chunk's ids back."""
    decode = _decoder(_pieces(df, tokenizer_path))

    def join(texts: pa.Table, coded: pa.Table) -> pa.Table:
        return pa.Table.from_batches(decode(_joined(texts, coded)), _DECODED)

    return _chunks(df, tokenizer_path, id_col, text_col, n_buckets).applyInArrow(join, "doc_id long, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """Row digests of :func:`bpe_decode`'s output: token count and SHA-256 of ids and decoded text."""
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
