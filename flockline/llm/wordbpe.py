"""BPE encoding and decoding through a distinct-word table."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Characters for which lower case, NFC and the word pattern are the same in every library and Unicode version.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ž]*")
#: The vocabulary's word pattern, for plain text.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Characters of text whose words share one dictionary; a longer document is a chunk of its own.
CHUNK = 24_000_000


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    """Cuts a text into the words that the tokenizer encodes one by one; a special token is a word."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        special = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.names = frozenset(special)

    def words(self, text: str) -> list[str]:
        if self.special and "<|" in text and self.special.search(text):
            return [w for part in self.special.split(text) for w in ([part] if part in self.names else self.of_part(part))]
        return self.of_part(text)

    def of_part(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return WORD.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(number, keys, texts) of each chunk of a partition, whose rows are (partition, key, text)."""
    number, keys, texts, size = 0, [], [], 0
    for b in batches:
        for part, key, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
            text = text.as_py() or ""
            if texts and size + len(text) > CHUNK:
                yield (part.as_py() << 32) + number, keys, texts
                number, keys, texts, size = number + 1, [], [], 0
            keys.append(key.as_py())
            texts.append(text)
            size += len(text)
            last = part.as_py()
    if texts:
        yield (last << 32) + number, keys, texts



def packed_ids(places: np.ndarray, ids: list[np.ndarray]) -> bytes:
    """Rising places as steps, numbers of ids and ids, in this order."""
    sizes = np.array([len(x) for x in ids], "<u4")
    return b"".join([struct.pack("<I", len(ids)), np.diff(places, prepend=0).astype("<u4").tobytes(), sizes.tobytes(), np.concatenate(ids).astype("<u4").tobytes()])


def unpacked_ids(blob: bytes) -> tuple[list[int], list[np.ndarray]]:
    n = struct.unpack_from("<I", blob)[0]
    values = np.frombuffer(blob, "<u4", offset=4)
    sizes = values[n : 2 * n].astype(np.int64)
    return np.cumsum(values[:n], dtype=np.int64).tolist(), np.split(values[2 * n :], np.cumsum(sizes)[:-1])


def encoded(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's token ids and the text that they decode to: ``key``, ids (binary, little-endian unsigned 32-bit), decoded.

    1. Each chunk of documents (24 million characters of a partition) lists its
       distinct words in the order in which they first occur.
    2. All chunks' rows of a word meet in one task, which encodes it once and
       joins its ids to their pieces (the vocabulary, a few MB, is the bounded side).
    3. The chunk's texts, compressed, meet the ids of its words, and each word's
       place gives its ids.

    The chunks of the two scans agree because Spark cuts the same files the same
    way; a chunk's number of words is checked. The pieces are joined by spaces, as
    the vocabulary names no decoder. Null text counts as empty and has no tokens;
    rows with equal or null keys stay rows of their own; an empty table gives none.
    The number of rows that name a very common word is that of the chunks, and they
    are encoded as they stream by, so no group is held. A lone document is split
    as a whole.
    """
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary)
        for number, _, texts in chunks(batches):
            seen: dict[str, None] = {}
            for t in texts:
                seen.update(dict.fromkeys(splitter.words(t)))
            words = list(seen)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.string())], ["chunk", "place", "word"])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        known: dict[str, np.ndarray] = {}
        for b in batches:
            words = b.column("word").to_pylist()
            kinds = list(dict.fromkeys(words))
            fresh = [w for w in kinds if w not in known]
            done = known | {w: np.array(x.ids, np.uint32) for w, x in zip(fresh, t.encode_batch_fast(fresh, add_special_tokens=False), strict=True)}
            # One row for each chunk in the batch: places, lengths and ids side by side.
            number = {w: i for i, w in enumerate(kinds)}
            of = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            chunk, place = b.column("chunk").to_numpy(), b.column("place").to_numpy()
            order = np.lexsort((place, chunk))
            names, starts = np.unique(chunk[order], return_index=True)
            blobs = []
            for rows in np.split(order, starts[1:]):
                ids = [done[kinds[k]] for k in of[rows]]
                blobs.append(zstandard.compress(packed_ids(place[rows], ids), 3))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], ["chunk", "ids"])
            # Rows are sorted by word: only the last word can go on in the next batch.
            known = {words[-1]: done[words[-1]]} if words else known

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, keys, texts in chunks(batches):
            whole = pa.table({"key": pa.array(keys, pa_kind), "text": pa.array(texts, pa.large_string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as out:
                out.write_table(whole)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], ["chunk", "packed"])

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        splitter = Splitter(vocabulary)
        pieces = pieces_of(vocabulary)
        found = [unpacked_ids(zstandard.decompress(x.as_buffer())) for x in right.column("ids")]
        ids: list[bytes] = [b""] * sum(len(places) for places, _ in found)
        decoded = [""] * len(ids)
        for places, of in found:
            for place, x in zip(places, of, strict=True):
                ids[place] = x.astype("<u4").tobytes()
                decoded[place] = " ".join([pieces[i] for i in x])
        del found
        out: list[pa.Table] = []
        for packed in left.column("packed"):
            whole = pa.ipc.open_stream(zstandard.decompress(packed.as_buffer())).read_all()
            seen: dict[str, int] = {}
            for at in range(0, whole.num_rows, 200):
                some = whole.slice(at, 200)
                found_ids, found_text = [], []
                for t in some.column("text"):
                    places = [seen.setdefault(w, len(seen)) for w in splitter.words(t.as_py())]
                    found_ids.append(b"".join([ids[p] for p in places]))
                    found_text.append(" ".join([x for p in places if (x := decoded[p])]))
                out.append(pa.table({key: some.column("key"), "ids": pa.array(found_ids, pa.binary()), "decoded": pa.array(found_text, pa.string())}))
            if len(seen) != len(ids):
                raise ValueError("the two scans of the documents disagree on a chunk's words")
        return pa.concat_tables(out)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(kind)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = rows.mapInArrow(list_words, "chunk long, place int, word string").repartition(parts, "word").sortWithinPartitions("word").mapInArrow(encode_words, "chunk long, ids binary")
    packed = rows.mapInArrow(pack, "chunk long, packed binary")
    schema = docs.select(F.col(key).alias(key)).schema.add("ids", "binary").add("decoded", "string")
    return packed.groupBy("chunk").cogroup(table.groupBy("chunk")).applyInArrow(join_back, schema)


@lru_cache(maxsize=2)
def pieces_of(vocabulary: str) -> list[str]:
    """The id-to-piece table."""
    named = tokenizer(vocabulary).get_vocab(with_added_tokens=True)
    out = [""] * (max(named.values()) + 1)
    for piece, i in named.items():
        out[i] = piece
    return out


def decoded(tokens: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Decodes any array of ids by a join with the id-to-piece table: ``key``, decoded.

    Unknown ids have no piece and are skipped; an empty or null array decodes to ''.
    ``key`` must tell rows apart. The piece table has a row for each id of the
    vocabulary, its proven bound.
    """
    spark = tokens.sparkSession
    pieces = spark.createDataFrame(list(enumerate(pieces_of(vocabulary))), "__id int, __piece string")
    placed = tokens.select(F.col(key).alias(key), F.posexplode_outer(ids).alias("__at", "__token"))
    joined = placed.join(F.broadcast(pieces), F.col("__token") == F.col("__id"), "left")
    sorted_pieces = F.array_sort(F.collect_list(F.when(F.col("__piece").isNotNull(), F.struct("__at", "__piece"))))
    return joined.groupBy(key).agg(F.array_join(F.transform(sorted_pieces, lambda x: x["__piece"]), " ").alias("decoded"))


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 of ``encoded``."""
    return encoded(docs, vocabulary, key).select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
