"""Token-ID files: independent zstandard frames, a trailing seek table, per-frame checksums.

A file holds documents in ascending id order:

    frame 0 .. frame n-1    zstandard frames, each the ids (unsigned 32 bit, little
                            endian) of some successive documents
    seek table              a zstandard frame: per frame its place, bytes, documents, ids and
                            the CRC32 of its uncompressed ids; then per document id and length
    footer, 24 bytes        length of the seek table, its CRC32, number of documents, magic

A reader fetches the footer and the table, then only the frames with requested
documents, and checks each against its checksum. Frames close at
``FRAME_IDS`` ids, so a document longer than that has a frame of its own.

Text is cut at single blanks before encoding: the tokenizer's own pattern always begins
a piece at a blank between two other characters, so pieces encode to the same ids as the text. Distinct pieces are encoded once per slice and kept in a bounded
table. Texts with blanks next to other white space are encoded whole.

Tasks write through the file system that the folder's address names, to a name
of the task's own, then rename it; a repeated task replaces its file with equal
content. The manifest lists what was kept.

Edge cases: a null text is an empty one (the end id only); repeated rows and rows of
one id follow each other in order of their text; null ids come first; an empty table gives
no file; extra columns are left out.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pannier.llm.words import filled, slices
from pannier.session import materialise, run_dir

END_ID = 2
FRAME_IDS = 1 << 16
LEVEL = 3
#: Distinct pieces remembered by a task.
KEPT_PIECES = 200_000
PIECE_BATCH = 4096
MAGIC = b"PNRTOK01"
_FOOTER = "<QII8s"
_FOOTER_BYTES = struct.calcsize(_FOOTER)
_NULL = -(1 << 63)
#: Texts that are encoded whole: blanks beside other white space, marks.
_ODD = r"[\s\pZ\x{85}\x0b\x1c-\x1f] | [\s\pZ\x{85}\x0b\x1c-\x1f]|<\|"


class Encoder:
    """Ids of whole texts by a tokenizer file, each distinct piece encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, list[int]] = {}
        self.elder: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for a file: tasks that follow each other in a worker share it."""
        import tokenizers

        kept = vars(tokenizers).setdefault("_encoders_by_path", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _plain(self, pieces: list[str]) -> Iterator[list[int]]:
        for lo in range(0, len(pieces), PIECE_BATCH):
            for e in self.tokenizer.encode_batch_fast(pieces[lo : lo + PIECE_BATCH], add_special_tokens=False):
                yield e.ids

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KEPT_PIECES:  # the elder half goes, what is in use moves on
            self.elder, self.known = self.known, {}
        known, elder = self.known, self.elder
        known.update((p, elder[p]) for p in pieces if p not in known and p in elder)
        new = [p for p in pieces if p not in known]
        known.update(zip(new, self._plain(new)))
        ids = [known[p] for p in pieces]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = filled(texts)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = np.array(next(self._plain([texts[int(i)].as_py()])), dtype=np.uint32)
        calm = np.flatnonzero(~odd)
        if not len(calm):
            return out
        lists = pc.split_pattern(texts.take(pa.array(calm)), " ")
        at = np.asarray(lists.offsets, dtype=np.int64)
        flat = lists.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        lead = np.ones(len(flat), bool)
        lead[at[:-1]] = False
        blank, none = pa.scalar(" ", flat.type), pa.scalar("", flat.type)
        marked = pc.binary_join_element_wise(pc.if_else(pa.array(lead), blank, none), flat, none)
        coded = marked.dictionary_encode()
        ids, lengths = self._pieces(coded.dictionary.to_pylist())
        starts = np.concatenate([[0], np.cumsum(lengths)])
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        shift = np.repeat(starts[:-1][which] - ends[:-1], n)
        joined = ids[np.arange(ends[-1]) + shift]
        for i, lo, hi in zip(calm, ends[at[:-1]], ends[at[1:]]):
            out[i] = joined[lo:hi]
        return out


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that an address names; an address without a scheme is a mounted folder."""
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


class Writer:
    def __init__(self, sink):
        self.sink, self.place = sink, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.parts: list[np.ndarray] = []
        self.waiting, self.docs = 0, 0
        self.frames: list[tuple[int, int, int, int, int]] = []
        self.names: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.waiting and self.waiting + len(ids) > FRAME_IDS:
            self._flush()
        self.parts.append(ids)
        self.waiting += len(ids)
        self.docs += 1
        self.names.append(_NULL if doc_id is None else doc_id)
        self.lengths.append(len(ids))

    def _flush(self) -> None:
        if not self.docs:
            return
        raw = np.concatenate(self.parts).astype("<u4").tobytes()
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.frames.append((self.place, len(packed), self.docs, self.waiting, zlib.crc32(raw)))
        self.place += len(packed)
        self.parts, self.waiting, self.docs = [], 0, 0

    def close(self) -> int:
        """Write what is left, the table and the footer; the number of ids."""
        self._flush()
        raw = struct.pack("<Q", len(self.frames))
        raw += np.array(self.frames, "<u8").tobytes()
        raw += np.array(self.names, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()
        table = self.packer.compress(raw)
        self.sink.write(table)
        self.sink.write(struct.pack(_FOOTER, len(table), zlib.crc32(raw), len(self.names), MAGIC))
        return int(sum(self.lengths))


class Reader:
    """Random access to one file; only asked-for frames are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER_BYTES)
        length, crc, n_docs, magic = struct.unpack(_FOOTER, source.read(_FOOTER_BYTES))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(size - _FOOTER_BYTES - length)
        raw = zstandard.ZstdDecompressor().decompress(source.read(length))
        if zlib.crc32(raw) != crc:
            raise ValueError("seek table is damaged")
        n = struct.unpack_from("<Q", raw)[0]
        self.frames = np.frombuffer(raw, "<u8", n * 5, 8).reshape(n, 5).astype(np.int64)
        self.names = np.frombuffer(raw, "<i8", n_docs, 8 + 40 * n)
        self.lengths = np.frombuffer(raw, "<u8", n_docs, 8 + 40 * n + 8 * n_docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 2])])

    def frame(self, f: int) -> list[np.ndarray]:
        place, packed, _, n_ids, crc = self.frames[f].tolist()
        self.source.seek(place)
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=n_ids * 4)
        if zlib.crc32(raw) != crc or len(raw) != n_ids * 4:
            raise ValueError(f"frame {f} is damaged")
        ends = np.cumsum(self.lengths[self.first[f] : self.first[f + 1]])[:-1]
        return np.split(np.frombuffer(raw, "<u4"), ends)

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every row of a document."""
        out = []
        for at in np.flatnonzero(self.names == doc_id):
            f = int(np.searchsorted(self.first, at, "right")) - 1
            out.append(self.frame(f)[at - self.first[f]])
        return out


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files of ascending ids; the manifest (part, path, n_docs, n_ids)."""
    spark = docs.sparkSession
    folder = folder or f"{run_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    parts = files or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = _open(folder)
        encoder = writer = sink = None
        for batch in batches:
            if batch.num_rows and writer is None:
                encoder = Encoder.of(tokenizer)
                system.create_dir(root, recursive=True)
                name = f"{root}/part-{part:06d}.ids"
                mine = f"{root}/_writing-{part:06d}-{uuid.uuid4().hex}"
                sink = system.open_output_stream(mine)
                writer = Writer(sink)
            for piece in slices(batch, "text"):
                names = piece.column("doc_id").to_pylist()
                for doc_id, ids in zip(names, encoder.encode(piece.column("text"))):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is None:
            return
        n_ids = writer.close()
        sink.close()
        system.move(mine, name)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int64()),
                pa.array([f"{folder}/part-{part:06d}.ids"]),
                pa.array([len(writer.names)], pa.int64()),
                pa.array([n_ids], pa.int64()),
            ],
            ["part", "path", "n_docs", "n_ids"],
        )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return materialise(ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. The running sum over
    files sees one short row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("ahead", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = placed.repartition(max(1, placed.sparkSession.sparkContext.defaultParallelism), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, ahead in zip(batch.column("path").to_pylist(), batch.column("ahead").to_pylist()):
                system, name = _open(path)
                with system.open_input_file(name) as source:
                    reader = Reader(source)
                    for f in range(len(reader.frames)):
                        rows = reader.frame(f)
                        lo, hi = reader.first[f], reader.first[f + 1]
                        lengths = np.array([len(r) for r in rows], np.int64)
                        names = reader.names[lo:hi]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(names, mask=names == _NULL),
                                pa.array(ahead + np.cumsum(lengths) - lengths),
                                pa.array(lengths),
                                pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        ahead += int(lengths.sum())

    return files.select("path", "ahead").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
