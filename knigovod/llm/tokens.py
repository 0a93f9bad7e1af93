"""Token files: documents as ids, in Arrow IPC files of equal-length sequences.

A part file holds one range of documents in ascending order of id. Its record batches have two columns of fixed-size
lists, `ids` (uint16, or uint32 for larger vocabularies) and `mask` (a bit, 1 for a real id), so a reader that maps the file finds sequence k of a batch
at k * sequence length, without copying. The schema's metadata holds the part's documents: ids, and numbers of tokens.

Tasks write below a shared folder under a name of their own attempt, and hand on a row that names the file. Only rows
of finished tasks become the manifest, so a lost or repeated task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knigovod.llm.shared import partitions, shared_folder, staged, text_bytes

SEQUENCE = 2048
SEQUENCES_A_BATCH = 256
END_ID = 0
#: Texts between two looks at the cache of encoded pieces, and pieces in each of its two generations.
TEXTS, PIECES = 256, 400_000

#: White space that a pre-tokenizer might join across the places where texts are cut.
JOINED = re.compile(r"\s |\s\s\s|\s\s\Z")

#: Letters (with number signs, which are told apart later), and ASCII marks but the apostrophe.
WORD_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")

#: Byte to character of the vocabulary: printable bytes stand for themselves, the others for U+0100 and up.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LEVEL = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}


class Encoder:
    """Encodes texts with a byte-level BPE tokenizer of the tokenizers library. Its pre-tokenizer never joins a piece
    across a single space, or before a line feed, so texts are cut there, and each distinct piece is encoded once while
    it stays in the cache. Texts with longer runs of white space are pre-tokenized whole; texts that hold the content of
    an added token are encoded by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens are matched before any cutting, so texts that hold one's content are left to the library.
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values() if a.content]
        self.cut, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.marks: dict[str, bytes] = {}
        self.feed = self._level(LEVEL[10])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _level(self, level: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(level)]).tobytes()

    def _ids(self, text: str) -> bytes:
        return b"".join([self._level(token) for token, _ in self.cut(text)])

    def _whole(self, text: str) -> bytes:
        """The ids that the library gives for a text, its added tokens among them."""
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Letters with the space before them: one pre-token. Bytes are written as the characters that stand for them
        in the vocabulary, the space as U+0120."""
        return self._level("\u0120" + (word if word.isascii() else word.encode().decode("latin-1").translate(LEVEL)))

    def _piece(self, piece: str) -> bytes:
        """A piece with the space before it, unless it begins with a line feed. A word, and the run of ASCII marks (but
        the apostrophe) that ends it, are pre-tokens; anything else is left to the pre-tokenizer."""
        if piece.isalpha():
            return self._word(piece)
        if piece[:1] == "\n":
            if piece[1:].isalpha():
                return self.feed + self._level(piece[1:].encode().decode("latin-1").translate(LEVEL))
            return self._ids(piece)
        parts = WORD_MARKS.fullmatch(piece)
        if not parts or not parts[1].isalpha():
            return self._ids(" " + piece)
        word, marks = parts.groups()
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self._level(marks)
        return (self.young.get(word) or self.old.get(word) or self._word(word)) + self.marks[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 16-bit numbers where the vocabulary allows, else 32-bit."""
        whole = {k: self._whole(t) for k, t in enumerate(texts) if any(a in t for a in self.added)}
        cut = [None if k in whole or JOINED.search(t) else t.replace("\n", " \n").split(" ") for k, t in enumerate(texts)]
        needed: set[str] = set()
        for parts in cut:
            if parts:
                needed.update(parts)
        fresh = needed.difference(self.young)
        if fresh:
            if len(self.young) > PIECES:
                self.old, self.young = self.young, {}
                fresh = needed
            known = self.old.get
            self.young.update([(p, known(p) or self._piece(p)) for p in fresh])
        get = self.young.__getitem__
        return [whole[k] if k in whole else self._ids(t) if parts is None else self._ids(parts[0]) + b"".join(map(get, parts[1:]))
                for k, (t, parts) in enumerate(zip(texts, cut))]


#: One encoder per tokenizer in a worker process; its cache serves one task after the other.
ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder, given as a path or as a URI in any form that Hadoop takes."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (pa.fs.LocalFileSystem(), folder) if folder.startswith("/") else pa.fs.FileSystem.from_uri(folder)


def _write(folder: str, part: int, ids: list, counts: list[int], pieces: list[bytes], length: int, kind: np.dtype) -> str:
    """One part file; its path below `folder`."""
    files, base = _store(folder)
    name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
    files.create_dir(base, recursive=True)
    schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
    documents = pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema) as writer:
        writer.write_table(documents)
    schema = schema.with_metadata({"documents": sink.getvalue().to_pybytes()})
    n = sum(counts)
    padded = -(-n // length) * length
    flat = np.frombuffer(b"".join([*pieces, bytes((padded - n) * kind.itemsize)]), kind)
    mask = np.arange(padded) < n
    with files.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_file(out, schema) as writer:
        step = length * SEQUENCES_A_BATCH
        for low in range(0, padded, step):
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[low:low + step]), length) for x in (flat, mask)]
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
    return name


def read_part(folder: str, name: str) -> tuple[pa.Table, pa.ipc.RecordBatchFileReader]:
    """The documents of a part, and a reader of its sequences; local files are mapped."""
    files, base = _store(folder)
    if isinstance(files, pa.fs.LocalFileSystem):
        reader = pa.ipc.open_file(pa.memory_map(f"{base}/{name}"))
    else:
        reader = pa.ipc.open_file(files.open_input_file(f"{base}/{name}"))
    documents = pa.ipc.open_stream(reader.schema.metadata[b"documents"]).read_all()
    return documents, reader


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Sequence k of a part, and its mask (a bit per id), as views of the file."""
    batch, row = reader.get_batch(k // SEQUENCES_A_BATCH), k % SEQUENCES_A_BATCH
    length = batch.schema.field("ids").type.list_size
    cut = lambda i: batch.column(i).flatten().slice(row * length, length)
    return cut(0).to_numpy(), cut(1)


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of a batch that its mask marks, in order."""
    return batch.column(0).flatten().filter(batch.column(1).flatten()).to_numpy()


#: Bytes of text in a file, more or less.
RANGE_BYTES = 64 << 20
MANIFEST = "part bigint, folder string, name string, n_docs bigint, n_tokens bigint"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
                 length: int = SEQUENCE) -> DataFrame:
    """Writes token files of all rows of `docs`, in ascending order of doc_id (null first, equal ids by text), and
    returns the manifest. Null texts are empty; each document ends with `END_ID`. `tokenizer` is a path that all
    executors have. No rows give no files. Other columns are not read."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"

    def run(batches):
        encoder, ids, counts, pieces = encoder_of(tokenizer), [], [], []
        kind = np.dtype(f"u{array(encoder.code).itemsize}")
        end = np.array([END_ID], kind).tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low in range(0, len(texts), TEXTS):
                for encoded in encoder.encode(texts[low:low + TEXTS]):
                    pieces.append(encoded + end)
                    counts.append(len(encoded) // kind.itemsize + 1)
            ids.extend(keys)
        if ids:
            part = TaskContext.get().partitionId()
            name = _write(folder, part, ids, counts, pieces, length, kind)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "folder": [folder], "name": [name],
                "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([sum(counts)], pa.int64())})

    given = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # A task holds the ids of its range until they are written, so the number of ranges follows the size of the corpus.
    ranges = max(partitions(spark), -(-text_bytes(docs, text) // RANGE_BYTES))
    ordered = given.repartitionByRange(ranges, "id").sortWithinPartitions("id", "text")
    return staged(ordered.mapInArrow(run, MANIFEST), "manifest")


OUT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 for each document, from the files. Parts are
    read side by side; where each starts is a running sum over the manifest, which has a row per part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                documents, reader = read_part(row["folder"], row["name"])
                counts = documents.column("n_tokens").to_numpy()
                starts = np.cumsum(counts) - counts
                flat = np.concatenate([ids_of(reader.get_batch(i)) for i in range(reader.num_record_batches)])
                sums = [zlib.crc32(flat[a:a + n].astype("<u4")) for a, n in zip(starts.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": documents.column("doc_id").combine_chunks(), "start": pa.array(starts + row["base"], pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    spread = parts.select("part", "folder", "name", "base").repartition(partitions(manifest.sparkSession), "part")
    return spread.mapInArrow(run, OUT)
