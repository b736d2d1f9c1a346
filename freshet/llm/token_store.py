"""Token ids as binary shards with Elias-Fano document boundaries.

A shard file holds, one after the other: the ids of its documents (unsigned 16 or 32 bit, little endian, each document
ended by ``end_id``), the ends of the documents as an Elias-Fano sequence over the concatenated id array, the document
keys (differences from the least one, a second such sequence), and a fixed-size trailer. Elias-Fano takes
``2 + log2(universe / n)`` bits a document; ``select`` answers "where does document i end" from sampled positions of
the high bits. The reader takes boundaries from there too, the documents of one sample at a time, so no table of 64-bit
offsets exists anywhere.

Rows are dealt by ranges of the key, so shards follow one another in key order. A manifest, written last, names the
finished files, their row and id counts and the number of ids before each. A task writes to a name of its own attempt
and renames; an attempt that is repeated writes the same bytes.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
from typing import TYPE_CHECKING, ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import Batches, commit_file, count_rows, gathered, map_texts, open_folder
from freshet.session import scratch_folder

if TYPE_CHECKING:
    from tokenizers import Tokenizer

DOCS_PER_SHARD = 8192
SAMPLE_EVERY = 256
TRAILER = "<6sBBqqqqqq"
MAGIC = b"EFTOK1"

MANIFEST = "shard int, path string, n_docs bigint, n_null_keys bigint, n_ids bigint, n_bytes bigint"


# ---------------------------------------------------------------------------------------------- Elias-Fano
@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of n values in [0, universe]: low bits packed, high bits in unary, samples of select."""

    n: int
    low_bits: int
    low: np.ndarray  # packed bits, uint8
    high: np.ndarray  # bitmap, uint8, little bit order
    samples: np.ndarray  # uint32: position in the bitmap of every SAMPLE_EVERY-th one

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bitmap = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
        bitmap[places] = 1
        lows = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return EliasFano(
            n, low_bits, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bitmap, bitorder="little"),
            places[::SAMPLE_EVERY].astype(np.uint32),
        )

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        begin, end = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))

    def select(self, i: int) -> int:
        """The i-th value, from one sample and the bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE_EVERY]), i % SAMPLE_EVERY
        byte, skip = divmod(place, 8)
        left += 1
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")[skip:]
            ones = np.flatnonzero(bits)
            if len(ones) >= left:
                at = byte * 8 + skip + int(ones[left - 1])
                return ((at - i) << self.low_bits) | int(self._low(i, 1)[0])
            left, byte, skip = left - len(ones), byte + 64, 0

    def run(self, first: int, count: int) -> np.ndarray:
        """The values from the first-th on, ``count`` of them: from the sample before the first to the one after the last."""
        if not count:
            return np.zeros(0, np.int64)
        before, after = first // SAMPLE_EVERY, -(-(first + count) // SAMPLE_EVERY)
        begin = int(self.samples[before])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        ones = begin + np.flatnonzero(bits)[first % SAMPLE_EVERY :][:count]
        return ((ones - np.arange(first, first + count)) << self.low_bits) | self._low(first, count)

    def decode(self) -> np.ndarray:
        return self.run(0, self.n)

    def to_bytes(self) -> bytes:
        head = struct.pack("<qqqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high, n_samples = struct.unpack_from("<qqqqq", data)
        low = np.frombuffer(data, np.uint8, n_low, 40)
        high = np.frombuffer(data, np.uint8, n_high, 40 + n_low)
        return EliasFano(n, low_bits, low, high, np.frombuffer(data, "<u4", n_samples, 40 + n_low + n_high))


# ---------------------------------------------------------------------------------------------- tokenizing
#: A text is cut before every blank and line end. No pre-token reaches over such a cut unless white space stands on both
#: sides of the blank (or it ends the text): texts with that are encoded in one, as are those that hold the mark itself
#: or an added token.
_MARK = "\x01"
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_UNCUT = _SPACE + r"[ \n](?:" + _SPACE + r"|\z)|\x01"
#: A sign after a letter or digit is a token of its own: it is split off.
_SIGNED = r"[\p{L}\p{N}][,.;:!?]\z"
_LONGEST_KEPT = 48
#: Pieces that a worker process remembers; with their ids they take about 30 bytes each.
_MOST_KEPT = 1_000_000
#: Bytes of text encoded in one go: the more, the fewer distinct pieces a byte has.
_ENCODE_BYTES = 4 << 20
#: Pieces given to the library in one go, which takes about a kilobyte for each until their ids are read.
_LEARN_PIECES = 2048
#: Pieces whose ids are gathered in one go.
_GATHER_PIECES = 1 << 16


@cache
def _tokenizer(vocabulary: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


class Encoder:
    """The tokenizers library behind a bounded memory of pieces: words repeat, and encoding one is slow.

    The memory is columns: the pieces as an Arrow array, their ids one after the other. A batch's distinct pieces are
    looked up in one call, and its ids gathered some pieces at a time; only pieces that are new become Python strings,
    again some at a time. Tasks take their encoder from ``Encoder.of``: a worker process serves many tasks, and what it
    learnt in one holds in the next.
    """

    _of: ClassVar[dict[tuple[str, int], Encoder]] = {}

    @staticmethod
    def of(vocabulary: str, id_bytes: int | None = None) -> Encoder:
        """This process's encoder. Without ``id_bytes``, two bytes an id where the vocabulary fits into them, else four."""
        if id_bytes is None:
            id_bytes = 2 if _tokenizer(vocabulary).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        if (vocabulary, id_bytes) not in Encoder._of:
            Encoder._of[vocabulary, id_bytes] = Encoder(vocabulary, id_bytes)
        return Encoder._of[vocabulary, id_bytes]

    def __init__(self, vocabulary: str, id_bytes: int) -> None:
        self.tokenizer = _tokenizer(vocabulary)
        self.code = np.dtype("<u2" if id_bytes == 2 else "<u4")
        self.added = {token.content: number for number, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.uncut = "|".join([_UNCUT, *map(re.escape, self.added)])
        self.kept = pa.array([], pa.string())
        self.ids = np.zeros(0, self.code)
        self.ends = np.zeros(1, np.int32)  # of each piece's ids, after a 0
        self.used = np.zeros(0, np.int32)
        self.turn = 0

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts, one after the other, and how many each has."""
        data, counts = [np.zeros(0, self.code)], [np.zeros(0, np.int32)]
        for at in range(0, len(texts), _LEARN_PIECES):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.slice(at, _LEARN_PIECES).to_pylist(), add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int32, len(found)))
            data.append(np.fromiter(chain.from_iterable(found), self.code, int(counts[-1].sum())))
        return np.concatenate(data), np.concatenate(counts)

    def _keep(self, pieces: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember pieces; beyond the limit the less recently used half goes first."""
        short = pc.less_equal(pc.utf8_length(pieces), _LONGEST_KEPT).to_numpy(zero_copy_only=False)
        ids, pieces, lengths = ids[np.repeat(short, lengths)], pieces.filter(pa.array(short)), lengths[short]
        if len(self.kept) + len(pieces) > _MOST_KEPT:
            stay = np.sort(np.argsort(self.used, kind="stable")[len(self.kept) // 2 + len(pieces) :])
            left = np.diff(self.ends)[stay]
            self.ids = self.ids[_runs(self.ends[stay], left)]
            self.ends = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
            self.kept, self.used = self.kept.take(pa.array(stay)), self.used[stay]
        self.kept = pa.concat_arrays([self.kept, pieces])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths, dtype=np.int32)])
        self.used = np.concatenate([self.used, np.full(len(pieces), self.turn, np.int32)])

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of distinct pieces are: an array of ids, where each piece's begin, and how many they are."""
        # The hash table is one of the pieces asked for, which are fewer than those remembered.
        found = pc.index_in(self.kept, value_set=pieces)
        place = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        old = found.drop_null().to_numpy()
        self.used[place] = self.turn
        ids, begins, lengths = self.ids, np.zeros(len(pieces), np.int64), np.full(len(pieces), -1, np.int64)
        begins[old], lengths[old] = self.ends[place], self.ends[place + 1] - self.ends[place]
        fresh = np.flatnonzero(lengths < 0)
        if len(fresh):
            new = pieces.take(pa.array(fresh))
            learnt, n = self._encode(new)
            begins[fresh], lengths[fresh] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, learnt])
            self._keep(new, learnt, n)
        return ids, begins, lengths

    def _cut(self, texts: pa.Array) -> pa.Array:
        marked = pc.replace_substring(texts, " ", _MARK + " ")
        return pc.split_pattern(pc.replace_substring(marked, "\n", _MARK + "\n"), _MARK)

    def _encoded(self, texts: pa.Array) -> tuple[Iterator[np.ndarray], np.ndarray]:
        """The ids of all texts, some at a time, and the number of each text's ids. Null counts as empty."""
        self.turn += 1
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False))
        apart, n_apart = self._encode(texts.take(pa.array(odd, pa.int64())))
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        lists = self._cut(texts)
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        del lists
        # A piece is a core and perhaps a sign: "word", "word," and "word." are looked up, and remembered, as one.
        pieces, index = coded.dictionary, coded.indices.to_numpy()
        signed = pc.match_substring_regex(pieces, _SIGNED)
        cores = pc.if_else(signed, pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        at = np.flatnonzero(signed.to_numpy(zero_copy_only=False))
        parts = pa.concat_arrays([cores, pc.utf8_slice_codeunits(pieces.filter(signed), -1)]).dictionary_encode()
        ids, begins, lengths = self._look_up(parts.dictionary)
        part = parts.indices.to_numpy()
        both = np.full((len(pieces), 2), len(begins), np.int32)
        both[:, 0], both[at, 1] = part[: len(pieces)], part[len(pieces) :]
        begins, lengths = np.append(begins, 0)[both], np.append(lengths, 0)[both]
        n_ids = lengths.sum(axis=1)
        sizes = n_ids.astype(np.int32)[index]
        cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[offsets]
        counts = np.diff(cuts)
        counts[odd] = n_apart

        def data() -> Iterator[np.ndarray]:
            # The ids of this batch's distinct pieces, then those of its pieces in order, with those of the odd texts between them.
            of_pieces = ids[_runs(begins.ravel(), lengths.ravel())]
            first = np.cumsum(n_ids) - n_ids
            stops = np.append(offsets[odd], len(index))
            done = at_odd = 0
            for k, stop in enumerate(stops.tolist()):
                for begin in range(done, stop, _GATHER_PIECES):
                    some = slice(begin, min(stop, begin + _GATHER_PIECES))
                    yield of_pieces[_runs(first[index[some]], sizes[some])]
                done = stop
                if k < len(odd):
                    yield apart[at_odd : at_odd + int(n_apart[k])]
                    at_odd += int(n_apart[k])

        return data(), counts

    def encode_array(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's ids. Null counts as empty."""
        some, counts = self._encoded(texts)
        data = b"".join(ids.tobytes() for ids in some)
        pa.default_memory_pool().release_unused()
        return data, counts

    def count_array(self, texts: pa.Array) -> np.ndarray:
        """The number of each text's ids, which are then not gathered."""
        counts = self._encoded(texts)[1]
        pa.default_memory_pool().release_unused()
        return counts


def _runs(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its length, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def with_token_counts(df: DataFrame, text: str, name: str, vocabulary: str | None = None) -> DataFrame:
    """Replace the column ``text`` by ``name``: the number of its ids in a store, the end included. Columns of the texts
    go through Python once."""
    path = vocabulary or default_vocabulary()
    kept = [c for c in df.columns if c != text]
    quoted = [F.col(f"`{c}`") for c in kept]

    def work(batches: Batches) -> Batches:
        encoder = Encoder.of(path)
        for batch in gathered(batches, _ENCODE_BYTES):
            counts = encoder.count_array(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(counts + 1, pa.int64())], names=[*kept, name])

    schema = T.StructType([*df.select(*quoted).schema, T.StructField(name, T.LongType())])
    return map_texts(df.select(*quoted, F.col(f"`{text}`")), work, schema)


# ---------------------------------------------------------------------------------------------- writing
def _write(folder: str, vocabulary: str, end_id: int, id_bytes: int) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        files, root = open_folder(folder)
        final = f"{root}/shard-{shard:06d}.tok"
        temporary = f"{root}/_temporary/{shard:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        encoder = Encoder.of(vocabulary, id_bytes)
        lengths: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        n_null = 0
        sink = None
        for batch in gathered(batches, _ENCODE_BYTES):
            if sink is None:
                files.create_dir(f"{root}/_temporary", recursive=True)
                sink = files.open_output_stream(temporary, compression=None)
            data, counts = encoder.encode_array(batch.column(1))
            sink.write(np.insert(np.frombuffer(data, encoder.code), np.cumsum(counts), end_id).tobytes())
            lengths.append(counts + 1)
            n_null += batch.column(0).null_count
            keys.append(batch.column(0).drop_null().to_numpy())
        if sink is None:
            return
        ends, names_in = np.cumsum(np.concatenate(lengths)), np.concatenate(keys)
        least = int(names_in[0]) if len(names_in) else 0
        bounds = EliasFano.encode(ends, int(ends[-1])).to_bytes()
        names = EliasFano.encode(names_in - least, int(names_in[-1]) - least if len(names_in) else 0).to_bytes()
        sink.write(bounds)
        sink.write(names)
        sink.write(struct.pack(TRAILER, MAGIC, id_bytes, 0, len(ends), n_null, int(ends[-1]), len(bounds), len(names), least))
        sink.close()
        commit_file(files, temporary, final)
        size = int(ends[-1]) * id_bytes + len(bounds) + len(names) + struct.calcsize(TRAILER)
        row = [shard, f"{folder}/shard-{shard:06d}.tok", len(ends), n_null, int(ends[-1]), size]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    return work


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_bytes: int = 2, docs_per_shard: int = DOCS_PER_SHARD,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode every whole text and write shards in ascending key order; returns the manifest with ``start``, the number
    of ids before each shard.

    Null text counts as empty. Null keys come first; equal keys are ordered by their texts' hash, and repeated rows each
    keep a place. An empty table gives an empty manifest. Other columns are ignored. ``vocabulary`` is a file that every
    executor has (a tokenizers JSON); ``id_bytes`` 2 holds vocabularies up to 65,536 ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    shards = max(spark.sparkContext.defaultParallelism, -(-docs.select(key).count() // docs_per_shard))
    tie = F.xxhash64("text")
    placed = rows.repartitionByRange(shards, F.col("key").asc_nulls_first(), tie).sortWithinPartitions(F.col("key").asc_nulls_first(), tie)
    map_texts(placed, _write(folder, vocabulary, end_id, id_bytes), MANIFEST).write.parquet(f"{folder}/_parts")
    # A row for each shard: small, whatever the corpus.
    before = F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_parts").withColumn("start", F.coalesce(before, F.lit(0)).cast("bigint"))
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, start bigint").parquet(f"{folder}/manifest")


# ---------------------------------------------------------------------------------------------- reading
class Shard:
    """A shard file opened for reading: its boundaries and keys are in memory, ids are read on demand."""

    def __init__(self, path: str) -> None:
        self.files, name = open_folder(path)
        self.source = self.files.open_input_file(name)
        size = self.source.size()
        self.source.seek(size - struct.calcsize(TRAILER))
        magic, self.id_bytes, _, self.n_docs, self.n_null, self.n_ids, n_bounds, n_names, self.least = struct.unpack(TRAILER, self.source.read(struct.calcsize(TRAILER)))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.source.seek(size - struct.calcsize(TRAILER) - n_names - n_bounds)
        self.bounds = EliasFano.from_bytes(self.source.read(n_bounds))
        self.names = EliasFano.from_bytes(self.source.read(n_names))

    def offset(self, i: int) -> int:
        """Where document i begins in the shard's id array."""
        return self.bounds.select(i - 1) if i else 0

    def ids(self, i: int) -> np.ndarray:
        """The ids of document i, its end id included."""
        return self.read(self.offset(i), self.bounds.select(i))

    def read(self, begin: int, end: int) -> np.ndarray:
        self.source.seek(begin * self.id_bytes)
        return np.frombuffer(self.source.read((end - begin) * self.id_bytes), "<u2" if self.id_bytes == 2 else "<u4")

    def keys(self, first: int = 0, count: int | None = None) -> list[int | None]:
        """The keys of ``count`` documents from the first-th on; null ones come first."""
        last = self.n_docs if count is None else first + count
        nulls = max(0, min(last, self.n_null) - first)
        begin = first + nulls - self.n_null
        return [None] * nulls + (self.names.run(begin, last - first - nulls) + self.least).tolist()

    def close(self) -> None:
        self.source.close()


_CHUNK_IDS = 1 << 20


def _read(batches: Batches) -> Batches:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(path)
            for sample in range(0, shard.n_docs, SAMPLE_EVERY):
                count = min(SAMPLE_EVERY, shard.n_docs - sample)
                ends, keys = shard.bounds.run(sample, count), shard.keys(sample, count)
                begins = np.concatenate([[shard.offset(sample)], ends[:-1]])
                crcs: list[int] = []
                while (first := len(crcs)) < count:
                    # As many documents as fit a chunk; a longer one goes alone, in chunks.
                    last = max(first + 1, int(np.searchsorted(ends, begins[first] + _CHUNK_IDS, side="right")))
                    if last == first + 1:
                        crcs.append(_crc_in_chunks(shard, int(begins[first]), int(ends[first])))
                    else:
                        ids = shard.read(int(begins[first]), int(ends[last - 1])).astype("<u4")
                        crcs += [zlib.crc32(part) for part in np.split(ids, ends[first : last - 1] - begins[first])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crcs, pa.int64())],
                    names=["key", "start", "n_tokens", "ids_crc32"],
                )
            shard.close()


def _crc_in_chunks(shard: Shard, begin: int, end: int) -> int:
    crc = 0
    for at in range(begin, end, _CHUNK_IDS):
        crc = zlib.crc32(shard.read(at, min(end, at + _CHUNK_IDS)).astype("<u4"), crc)
    return crc


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document, from the files the manifest names: ``key``, ``start`` (ids before it in the whole store),
    ``n_tokens`` (with the end id), ``ids_crc32`` (of the ids as little-endian unsigned 32 bit)."""
    shards = read_manifest(spark, folder).select("path", "start")
    tasks = max(1, min(count_rows(spark, f"{folder}/manifest"), 16 * spark.sparkContext.defaultParallelism))
    return shards.repartition(tasks, "path").mapInArrow(_read, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def store_tokens(docs: DataFrame, vocabulary: str | None = None, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and read it back; columns as ``read_tokens``, key ``doc_id``."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "tokens")
    write_tokens(docs, folder, vocabulary or default_vocabulary(), docs_per_shard=docs_per_shard)
    return read_tokens(spark, folder).withColumnRenamed("key", "doc_id")


def tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
