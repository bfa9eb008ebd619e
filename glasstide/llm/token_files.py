"""Token ids as flat binary files with 64-bit document offsets.

Texts are dealt by range of doc_id, encoded by the tokenizers library, and every task writes one shard: its ids end to end as
unsigned little-endian integers (16 bits where the vocabulary allows it, else 32), the documents' offsets among them as 64-bit
integers, and the documents' own ids as an Arrow file. A shard's place in the whole is the sum of all shards before it. The manifest,
written last, names the files of the attempts that succeeded, so that files of a lost or repeated task are never read. Readers map
shards into memory and take document by document from them.

The library meets each distinct piece of a run of texts once: pieces begin where a byte-level pre-tokenizer surely breaks, so that the
ids of a text are those of its pieces, one after another. With other tokenizers a whole text is one piece.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import chunks, ragged, text_buffers
from .bpe import byte_letters

#: Bytes of text encoded at a time, a longer document alone; pieces that a task remembers before it forgets them all.
CHUNK, REMEMBERED = 4 << 20, 600_000
#: Ids handed on at a time when shards are read.
READ_IDS = 1 << 20
MANIFEST = "shard int, name string, width int, documents long, ids long, first_document long, first_id long"


def breaks_by_class(spec: dict) -> bool:
    """Whether the tokenizer is a plain byte-level one, whose pre-tokenizer breaks wherever piece_starts() says."""
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec["model"]["type"] == "BPE"
    special = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", []))
    return plain and not special and not spec.get("normalizer") and not spec.get("post_processor")


_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _SPACE, _WHITE = range(7)


def _classes() -> np.ndarray:
    """By byte: ASCII letter, digit, mark, apostrophe, space, other white space, or something else."""
    out = np.full(256, _OTHER, np.uint8)
    out[33:127] = _MARK
    out[[*range(65, 91), *range(97, 123)]] = _LETTER
    out[48:58] = _DIGIT
    out[39], out[32], out[9:14] = _APOSTROPHE, _SPACE, _WHITE
    return out


def _class_of(raw: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of accented Latin letters (U+00C0 to U+023F, without the signs for times and divided by) are letters."""
    c = CLASS[raw]
    lead = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC8))
    lead = lead[(raw[lead] != 0xC3) | (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    c[lead] = c[lead + 1] = _LETTER
    return c


def _breaks() -> np.ndarray:
    """By class of a byte and of the next, 8 * one + other: whether a piece surely ends between them.

    White space after something else begins a piece; letters, digits and marks never share one. An apostrophe may belong to either
    side (a contraction), so nothing is cut beside it.
    """
    out = np.zeros(64, bool)
    solid = (_LETTER, _DIGIT, _MARK)
    for a in (*solid, _APOSTROPHE):
        out[[8 * a + _SPACE, 8 * a + _WHITE]] = True
    for a in solid:
        out[[8 * a + b for b in solid if b != a]] = True
    return out


CLASS, BREAKS = _classes(), _breaks()
#: Pieces that are one stretch of one class, with a space before it or none: no pre-tokenizer need look at them.
PLAIN = re.compile(r" ?(?:[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u023F]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def piece_starts(raw: np.ndarray, offsets: np.ndarray, uncut: np.ndarray | None = None) -> np.ndarray:
    """Where pieces begin: at every document that is not empty and wherever a byte-level pre-tokenizer surely breaks.

    uncut: documents that stay one piece.
    """
    starts = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        c = _class_of(raw)
        pair = c[:-1] * np.uint8(8) + c[1:]
        starts[1:-1] = BREAKS[pair]
        # Other two-byte characters before white space: their first byte tells that they are no white space themselves.
        white = np.flatnonzero((c[2:] >= _SPACE) & (raw[1:-1] >= 0x80)) + 2
        lead = raw[white - 2]
        starts[white[(lead >= 0xC3) & (lead < 0xE0)]] = True
        # A single line end between two other characters is a piece of its own.
        alone = np.flatnonzero(starts[:-1] & (c == _WHITE)[: len(starts) - 1]) + 1
        alone = alone[alone < len(raw)]
        starts[alone[(c[alone] >= _LETTER) & (c[alone] <= _MARK)]] = True
    for i in uncut if uncut is not None else ():
        starts[offsets[i] : offsets[i + 1]] = False
    starts[offsets[:-1]] = True
    return np.flatnonzero(starts[:-1])


class TextEncoder:
    """Ids of texts by a tokenizer file's content; remembers pieces that it has met."""

    def __init__(self, content: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(content)
        self.apart = breaks_by_class(spec)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", []) if t["content"]]
        self.letters = dict(enumerate(byte_letters()))
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        """known: the pieces; ids: their ids end to end; ends: how many ids there are up to each piece's end."""
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        """The library's ids of each piece. A plain piece is a word of the library's model as it stands, with its bytes written as letters."""
        if not self.apart:
            return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        words, plain, letters = self.tokenizer.model.tokenize, PLAIN.fullmatch, self.letters
        out = [[t.id for t in words(p.encode().decode("latin-1").translate(letters))] if plain(p) else None for p in pieces]
        rest = [i for i, o in enumerate(out) if o is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece stands among the known ones; new ones are encoded first."""
        if len(self.known) >= self.remembered:
            self._forget()
        new = pieces.filter(pc.invert(pc.is_in(pieces, value_set=self.known)))
        if len(new):
            found = []
            for a in range(0, len(new), 4096):
                found += self._encoded(new.slice(a, 4096).to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(f) for f in found])])
        return pc.index_in(pieces, value_set=self.known).to_numpy().astype(np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts end to end, and how many each text has."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if self.apart:
            starts = piece_starts(raw, offsets, self._with_special(raw, offsets))
        else:
            starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
        bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        place = self._places(pieces.dictionary)[pieces.indices.to_numpy()]
        lengths = self.ends[place + 1] - self.ends[place]
        ids = self.ids[ragged(self.ends[place], lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def _with_special(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents in which the name of a special token stands: the library cuts these itself."""
        content, found = raw.tobytes(), []
        for name in self.special:
            at = content.find(name)
            while at >= 0:
                found.append(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = content.find(name, at + 1)
        return np.unique(np.array(found, np.int64))


_ENCODERS: dict[int, TextEncoder] = {}


def _encoder(content: str) -> TextEncoder:
    """One encoder for each tokenizer in a Python worker, whose tasks follow one another."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(content)
    return _ENCODERS[key]


def write_token_files(documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Writes the ids of all documents, each followed by end_id, in ascending order of doc_id; returns the manifest's rows.

    documents: doc_id, text, and any other columns, which are ignored whatever their names. folder: a new folder's URI in a store that
    driver and executors share (local paths, hdfs, s3 and what else Arrow opens). A null text counts as empty and has the end id alone;
    very long texts are encoded whole; rows without doc_id come first; rows that share a doc_id follow one another by a hash of their
    text, repeated rows each have a place; an empty table gives a manifest without rows. The tokenizer file is read on the driver and
    broadcast: its size is fixed.
    """
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    vocabulary = TextEncoder(content, 0).tokenizer.get_vocab_size(with_added_tokens=True)
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    tokenizer = spark.sparkContext.broadcast(content)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store, root = fs.FileSystem.from_uri(_uri(folder))
    store.create_dir(root)

    rows = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(shards, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = _encoder(tokenizer.value)
        files, top = fs.FileSystem.from_uri(_uri(folder))
        number = TaskContext.get().partitionId()
        name = f"shard-{number:05d}-{uuid.uuid4().hex}"
        total = documents_here = 0
        kind = pa.schema([first.schema.field(0)])
        with files.open_output_stream(f"{top}/{name}.bin") as ids_file, files.open_output_stream(f"{top}/{name}.idx") as idx_file, files.open_output_stream(f"{top}/{name}.doc") as doc_file:
            idx_file.write(np.zeros(1, "<i8").tobytes())
            with pa.ipc.new_file(doc_file, kind) as keys:
                for batch in _chained(first, batches):
                    keys.write_batch(pa.RecordBatch.from_arrays([batch.column(0)], schema=kind))
                    for _, _, raw, offsets in chunks(*text_buffers(batch.column(1)), CHUNK):
                        ids, counts = encoder.encode(raw, offsets)
                        ids = np.insert(ids, np.cumsum(counts), end_id)
                        ids_file.write(ids.astype(f"<u{width}").tobytes())
                        idx_file.write((total + np.cumsum(counts + 1)).astype("<i8").tobytes())
                        total += len(ids)
                        documents_here += len(counts)
        yield pa.RecordBatch.from_pylist([{"shard": number, "name": name, "documents": documents_here, "ids": total}], pa.schema([("shard", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    done = sorted(dealt.mapInArrow(written, "shard int, name string, documents long, ids long").collect())  # a row for each shard
    bases, found = (0, 0), []
    for r in done:
        found.append((r["shard"], r["name"], width, r["documents"], r["ids"], *bases))
        bases = (bases[0] + r["documents"], bases[1] + r["ids"])
    manifest = spark.createDataFrame(found, MANIFEST)
    manifest.coalesce(1).write.json(f"{_uri(folder)}/manifest")
    return manifest


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from (b for b in rest if b.num_rows)


def _uri(folder: str) -> str:
    return folder if ":/" in folder else f"file://{os.path.abspath(folder)}"


def _opened(files: fs.FileSystem, path: str):
    """A file to read from at any place: mapped into memory where the store is a local one."""
    return pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document: how many ids stand before its own, their number, and they themselves.

    ids are unsigned little-endian 32-bit integers, as one binary value, the end id among them. Shards are read side by side.
    """
    manifest = spark.read.schema(MANIFEST).json(f"{_uri(folder)}/manifest")
    names = [r["name"] for r in manifest.select("name").orderBy("shard").limit(1).collect()]  # any shard tells the type of doc_id
    if not names:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    from pyspark.sql.pandas.types import from_arrow_type

    store, root = fs.FileSystem.from_uri(_uri(folder))
    with _opened(store, f"{root}/{names[0]}.doc") as source:
        key = from_arrow_type(pa.ipc.open_file(source).schema.field(0).type).simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(_uri(folder))
        for batch in batches:
            for shard in batch.to_pylist():
                yield from _documents(files, f"{top}/{shard['name']}", shard["width"], shard["first_id"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = manifest.select("name", "width", "first_id").repartition(n)
    return dealt.mapInArrow(read, f"doc_id {key}, start long, n_tokens long, ids binary")


def _documents(files: fs.FileSystem, path: str, width: int, base: int) -> Iterator[pa.RecordBatch]:
    """A shard's documents, about READ_IDS ids at a time."""
    with _opened(files, f"{path}.bin") as ids_file, _opened(files, f"{path}.idx") as idx_file, _opened(files, f"{path}.doc") as doc_file:
        keys = pa.ipc.open_file(doc_file)
        before = 0
        for b in range(keys.num_record_batches):
            own = keys.get_batch(b).column(0)
            at = np.frombuffer(idx_file.read_at(8 * (len(own) + 1), 8 * before), "<i8")
            before += len(own)
            a = 0
            while a < len(own):
                z = max(a + 1, int(np.searchsorted(at, at[a] + READ_IDS, side="right")) - 1)
                ids = np.frombuffer(ids_file.read_at(width * int(at[z] - at[a]), width * int(at[a])), f"<u{width}").astype("<u4")
                bounds = pa.py_buffer((4 * (at[a : z + 1] - at[a])).astype(np.int32)) if len(ids) < 1 << 29 else None
                if bounds is None:  # one document of over two billion bytes of ids
                    raise ValueError(f"{path}: a document has {len(ids)} ids, more than one value can hold")
                values = pa.Array.from_buffers(pa.binary(), z - a, [None, bounds, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([own.slice(a, z - a), pa.array(base + at[a:z]), pa.array(np.diff(at[a : z + 1])), values], names=["doc_id", "start", "n_tokens", "ids"])
                a = z
