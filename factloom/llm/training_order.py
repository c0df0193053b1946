"""Training-order materialisation of token ids.

Token ids of all documents, each closed by an end mark, are packed into
sequences of a fixed length and written in a random order that a key fixes. A
keyed Feistel network over the smallest even number of bits that holds the N
sequences, walked along its cycles until a value below N comes, is a permutation
of [0, N): it gives each sequence its global slot without a sort or a table. Slots
are cut into ranges; each range is one shard, written front to back, so slot s is found
at byte (s mod per_shard) * stride of shard s div per_shard, and a reader resumes at
any slot.

Sequences are numbered where they lie: input partitions are counted first, and the offset
of each partition is what goes to all tasks. A writing task owns a range of shards; it names
files by attempt and returns their names, and only named files are read, so a task that runs twice
leaves a file that nothing reads.

The query's ids are those of a byte-level BPE, which decode to the very text.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

LENGTH = 2048
PER_SHARD = 8192
#: Parts of the shards that are written one after the other, so that their shuffle takes disk for one part at a time.
WAVES = 2
#: Shards that a writing task makes, where there are many.
TASK_SHARDS = 8
KEY = 0x5EED
ROUNDS = 6
#: Byte tokens: a text's UTF-8 bytes are its ids; these two bytes never occur in UTF-8.
END, PAD = 0xFE, 0xFF
#: BPE ids: bytes of an id; the vocabulary of 50,256 ranks leaves the next id free for the end mark.
WIDTH = 2
BPE_END, BPE_PAD = 50_256, 0xFFFF
#: Characters of a text that are encoded at once; a longer text is cut before a space where it has one.
PIECE = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of sequence numbers x < n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def byte_ids(text: Column) -> Column:
    """A text's byte tokens, as binary."""
    return F.coalesce(text, F.lit("")).cast("binary")


_ENCODINGS: dict[str, object] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoding(path: str):
    """The byte-level BPE whose ranks ``path`` holds; one for each worker process."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (space := text.rfind(" ", at + 1, end)) > 0:
            end = space
        yield text[at:end]
        at = end


def bpe_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian uint16) of every row's whole text; a null or empty text has no ids."""
    path = path or default_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        if e.max_token_value >= 1 << 8 * WIDTH:
            raise ValueError(f"ids of {path} don't fit {WIDTH} bytes")
        for b in batches:
            ids = [b"".join(np.array(e.encode_ordinary(x), "<u2").tobytes() for x in pieces(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, ids binary")


def materialise(docs: DataFrame, ids: Column, scratch: Scratch, id_col: str = "doc_id", width: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD, end: int = END, pad: int = PAD, key: int = KEY) -> tuple[DataFrame, str]:
    """Writes the shards and returns (one row per sequence, folder).

    ``ids`` is binary: little-endian unsigned ids of ``width`` bytes. Rows:
    slot, sequence, shard, byte_offset, first_doc_id, n_tokens (without padding), crc32 of
    the sequence's bytes. A null or empty text is its end mark alone. No rows: no shards.
    The plan of ``docs`` must deal rows to partitions alike each time it runs, as file scans do;
    a second run that deals them otherwise fails.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch.folder("shards")
    stride = length * width
    rows = docs.select(F.col(id_col).alias("id"), ids.alias("ids"))
    counted = docs.select((F.octet_length(ids) + width).cast("long").alias("bytes")).groupBy(F.spark_partition_id().alias("part")).agg(F.sum("bytes").alias("bytes"))
    sizes = {r["part"]: r["bytes"] for r in counted.collect()}  # one number for each input partition
    offsets, n = {}, 0
    for part in sorted(sizes):
        offsets[part] = n
        n += -(-sizes[part] // stride)
    shared = spark.sparkContext.broadcast((sizes, offsets, n))
    kind = docs.schema[id_col].dataType
    end_mark = int(end).to_bytes(width, "little")
    pad_mark = int(pad).to_bytes(width, "little")

    def pack(batches: Iterator[pa.RecordBatch], first_shard: int, end_shard: int) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        all_sizes, all_offsets, total = shared.value
        number, seen = all_offsets.get(part, 0), 0
        buffer, first, arrow_id = bytearray(), None, None
        firsts, data, used = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal firsts, data, used, number
            numbers = np.arange(number, number + len(data), dtype=np.int64)
            slots = permute(numbers, total, key)
            number += len(data)
            mine = np.flatnonzero((slots >= first_shard * per_shard) & (slots < end_shard * per_shard))
            slots, numbers = slots[mine], numbers[mine]
            data, firsts, used = ([x[i] for i in mine] for x in (data, firsts, used))
            crc = [zlib.crc32(d) for d in data]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(numbers), pa.array((slots // per_shard).astype(np.int32)), pa.array(firsts, arrow_id), pa.array(used, pa.int32()), pa.array(crc, pa.int64()), pa.array([zlib.compress(d, 1) for d in data], pa.binary())],
                names=["slot", "sequence", "shard", "first_doc_id", "n_tokens", "crc32", "data"],
            )
            firsts, data, used = [], [], []
            return batch

        def cut(whole: bool) -> None:
            nonlocal first
            at = 0
            while len(buffer) - at >= stride or (whole and len(buffer) > at):
                d = bytes(buffer[at : at + stride])
                used.append(len(d) // width)
                data.append(d + pad_mark * ((stride - len(d)) // width))
                firsts.append(first)
                first = current
                at += stride
            del buffer[:at]

        current = None
        for b in batches:
            arrow_id = b.column(0).type
            for i in range(b.num_rows):
                current = b.column(0)[i].as_py()
                value = b.column(1)[i].as_buffer()
                if not buffer:
                    first = current
                buffer += memoryview(value) if value is not None else b""
                buffer += end_mark
                seen += (value.size if value is not None else 0) + width
                if len(buffer) >= stride:
                    cut(False)
                if len(data) >= 512:
                    yield flush()
        cut(True)
        if data:
            yield flush()
        if seen != all_sizes.get(part, 0):
            raise ValueError(f"partition {part} held {all_sizes.get(part, 0)} bytes of ids when counted and {seen} now")

    packed = lambda first, end: rows.mapInArrow(lambda batches: pack(batches, first, end), f"slot long, sequence long, shard int, first_doc_id {kind.simpleString()}, n_tokens int, crc32 long, data binary")
    shards = -(-n // per_shard)
    waves = min(WAVES, max(1, shards))
    per_task = TASK_SHARDS if shards >= 4 * TASK_SHARDS * spark.sparkContext.defaultParallelism else 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out = name = None
        shard = -1
        for b in batches:
            names = []
            for at, data in zip(b.column("shard").to_pylist(), b.column("data"), strict=True):
                if at != shard:
                    if out is not None:
                        out.close()
                    shard, name = at, f"shard-{at:08d}-{uuid.uuid4().hex}.bin"
                    out = fs.open_output_stream(f"{root}/{name}")
                out.write(zlib.decompress(memoryview(data.as_buffer())))
                names.append(name)
            slots = b.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("slot", "sequence", "shard")), pa.array(slots % per_shard * stride), *(b.column(c) for c in ("first_doc_id", "n_tokens", "crc32")), pa.array(names, pa.string())], names=["slot", "sequence", "shard", "byte_offset", "first_doc_id", "n_tokens", "crc32", "file"])
        if out is not None:
            out.close()

    done = None
    for wave in range(waves):
        first, end = shards * wave // waves, shards * (wave + 1) // waves
        ordered = packed(first, end).repartitionById(max(1, -(-(end - first) // per_task)), F.expr(f"cast((shard - {first}) div {per_task} as int)")).sortWithinPartitions("slot")
        part = scratch.write(ordered.mapInArrow(write, f"slot long, sequence long, shard int, byte_offset long, first_doc_id {kind.simpleString()}, n_tokens int, crc32 long, file string"), "sequences")
        done = part if done is None else done.union(part)
    done.where(F.col("byte_offset") == 0).select("shard", "file").write.parquet(f"{folder}/files")
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps({"sequences": n, "shards": shards, "per_shard": per_shard, "length": length, "width": width, "end": end, "pad": pad, "key": key}).encode())
    return done.drop("file"), folder


def shard_files(folder: str, first: int, last: int) -> dict[int, str]:
    """The files of shards ``first`` to ``last``."""
    fs, root = pafs.FileSystem.from_uri(folder)
    found = pads.dataset(f"{root}/files", format="parquet", filesystem=fs).to_table(filter=(pads.field("shard") >= first) & (pads.field("shard") <= last))
    return dict(zip(found["shard"].to_pylist(), found["file"].to_pylist(), strict=True))


def read_slots(folder: str, start: int, count: int) -> np.ndarray:
    """``count`` sequences from slot ``start`` on, as an array of ids; a sequential read of their shards."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/index.json") as f:
        index = json.loads(f.read())
    stride, per = index["length"] * index["width"], index["per_shard"]
    count = max(0, min(count, index["sequences"] - start))
    names = shard_files(folder, start // per, (start + count - 1) // per) if count else {}
    parts = []
    while count:
        shard, at = divmod(start, per)
        some = min(count, per - at)
        with fs.open_input_file(f"{root}/{names[shard]}") as f:
            f.seek(at * stride)
            parts.append(f.read(some * stride))
        start, count = start + some, count - some
    return np.frombuffer(b"".join(parts), f"<u{index['width']}").reshape(-1, index["length"])


def op8(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "shards")
    encoded = scratch.write(bpe_ids(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id"), "ids", compression="zstd")  # else each text is encoded once to count and once to pack
    done, _ = materialise(encoded, F.col("ids"), scratch, width=WIDTH, end=BPE_END, pad=BPE_PAD)
    scratch.drop(encoded)
    return done
