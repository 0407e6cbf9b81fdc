"""Token ids in Arrow files of equal-length sequences, for random access without copying.

A file holds record batches of SEQUENCES sequences: `ids`, a fixed-size list of token ids, and
`mask`, a fixed-size list of booleans (False: filling at the end of the file). Documents follow
one another without gaps; token i of a file is item i mod length of sequence i div length.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
from marketlens.llm import textbytes, tokens
from marketlens.llm.runtime import file_system, ship, stored
from marketlens.session import new_table_path
from pyspark.sql import Window
from pyspark.sql import functions as F

LENGTH = 2048
SEQUENCES = 128
SLICE_BYTES = 4 << 20
INDEX = "doc_id long, file string, first long, n_tokens long"


def schema(dtype, length):
    return pa.schema(
        [
            ("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
            ("mask", pa.list_(pa.bool_(), length)),
        ]
    )


class TokenWriter:
    """Appends token ids to a file; `close` fills up the last sequence."""

    def __init__(self, sink, dtype, length=LENGTH):
        self.schema, self.length = schema(dtype, length), length
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held, self.n_held, self.written = [], 0, 0

    def append(self, ids):
        self.held.append(ids)
        self.n_held += len(ids)
        block = self.length * SEQUENCES
        if self.n_held >= block:
            flat = np.concatenate(self.held)
            whole = len(flat) // block * block
            for at in range(0, whole, block):
                self._batch(flat[at : at + block], block)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _batch(self, ids, n_real):
        mask = np.arange(len(ids)) < n_real
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)
        ]
        columns = [c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.written += n_real

    def close(self):
        if self.n_held:
            flat = np.concatenate(self.held)
            filled = np.zeros(-(-len(flat) // self.length) * self.length, flat.dtype)
            filled[: len(flat)] = flat
            self._batch(filled, len(flat))
        self.file.close()


class TokenReader:
    """Random access to the tokens of a file; arrays are views of the file's buffers."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.block = self.length * SEQUENCES
        self.number, self.batch = None, None

    def _batch(self, number):
        if number != self.number:
            self.number, self.batch = number, self.file.get_batch(number)
        return self.batch

    def sequences(self, number):
        """Ids and mask of a batch as matrices, one row per sequence."""
        batch = self._batch(number)
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        return ids.reshape(-1, self.length), mask.reshape(-1, self.length)

    def tokens(self, first, n):
        """n tokens from number `first` on; a view if they lie in one batch."""
        parts, end = [], first + n
        while first < end:
            number, at = divmod(first, self.block)
            ids = self._batch(number).column(0).flatten().to_numpy(zero_copy_only=True)
            part = ids[at : at + end - first]
            if not len(part):
                raise EOFError(f"The file ends before token {end}.")
            parts.append(part)
            first += len(part)
        if len(parts) == 1:
            return parts[0]
        return np.concatenate(parts) if parts else np.empty(0, np.uint16)


def open_tokens(system, path):
    """A reader; a local file is mapped into memory and not read in."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        return TokenReader(pa.memory_map(path))
    return TokenReader(system.open_input_file(path))


def write_token_files(docs, folder, tokenizer_path, end_id, length=LENGTH):
    """Write the ids of all texts in ascending doc_id order; return the stored index.

    Each document ends with `end_id`; null and empty texts have that id only. The index has a row
    per row of `docs`: doc_id, file, first (the place of its first token in the file) and
    n_tokens. Rows without doc_id come first; repeated ids are ordered by text, a hash of it
    deciding. Files hold ranges of doc_id. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    ordered = (
        rows.withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
    )

    def write(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        coder = tokens.encoder(tokenizer_path)
        name, sink, writer, at = f"{uuid.uuid4().hex}.arrow", None, None, 0
        try:
            for part in textbytes.slices(batches, 1, SLICE_BYTES):
                if writer is None:
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                    writer = TokenWriter(sink, coder.dtype, length)
                ids, before = coder.encode(*textbytes.flat(part.column(1)))
                ids, before = tokens.with_end(ids, before, end_id)
                writer.append(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([name] * part.num_rows, pa.string()),
                        pa.array(at + before[:-1], pa.int64()),
                        pa.array(np.diff(before), pa.int64()),
                    ],
                    ["doc_id", "file", "first", "n_tokens"],
                )
                at += len(ids)
        finally:
            if writer is not None:
                writer.close()
                sink.close()

    return stored(ordered.mapInArrow(write, INDEX), "token-index")


def read_documents(index, folder):
    """Per row of the index: its tokens' number and CRC-32, read from the files, and its start.

    start counts the ids of all documents before it in all files. Files are ranges of doc_id, so
    their order is that of their smallest ids; one row per file is enough to add up.
    """
    files = index.groupBy("file").agg(
        F.min("doc_id").alias("least"), F.sum("n_tokens").alias("tokens")
    )
    order = Window.orderBy(F.col("least").asc_nulls_first(), "file")
    before = files.withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))

    def read(batches):
        system, root = file_system(folder)
        name, reader = None, None
        for batch in batches:
            crcs, counts = [], []
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            for file, first, n in zip(*columns, strict=True):
                if file != name:
                    name, reader = file, open_tokens(system, f"{root}/{file}")
                ids = reader.tokens(first, n)
                counts.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "file", "first", "n_tokens", "ids_crc32"],
            )

    near = index.repartition("file").sortWithinPartitions("file", "first")
    found = near.mapInArrow(read, INDEX + ", ids_crc32 long")
    return found.join(before.select("file", "before"), "file").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_round_trip(docs, tokenizer_path, end_id=1, folder=None):
    """Write all texts as token files, read them back, and return one row per document."""
    folder = folder or new_table_path(docs.sparkSession, "token-files")
    return read_documents(write_token_files(docs, folder, tokenizer_path, end_id), folder)
