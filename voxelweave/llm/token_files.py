"""Token ids in binary files: a concatenated id array with Elias-Fano encoded document boundaries.

Texts are range-partitioned and sorted by doc_id, tokenised in the tasks and written as files of a bounded size below one
folder. A file holds whole documents and these parts, little-endian:

    header      magic "EFTOKEN1", then documents, ids, low bits, bytes per id, null ids, samples (six unsigned 32-bit numbers)
    samples     unsigned 32-bit: bit position of every 256th set bit of the upper part
    lower       the low bits of each boundary, packed
    upper       boundary i's remaining high bits in unary: bit (high + i) is set
    doc ids     signed 64-bit, ascending, nulls first (as zeros)
    ids         unsigned, 2 bytes each if the vocabulary allows, else 4

A boundary is the end of a document, counted in ids from the file's begin: n boundaries below u take about n (2 + log2(u / n))
bits. ``Boundaries.end(i)`` selects one from its sample by counting bits; nothing is unpacked to a table.

A file is written under a passing name and renamed, and its name comes from partition and number, so a retried or doubled
task leaves the same file. Only files listed in the manifest, a table written by Spark, count.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from voxelweave.llm.common import sized, stored
from voxelweave.session import work_path

MAGIC, HEADER, SAMPLE = b"EFTOKEN1", struct.Struct("<8s6I"), 256
MANIFEST = "part int, number int, path string, documents long, ids long"
#: Text with other white space than blanks and line feeds, or with a special token, goes to the tokenizer as a whole.
UNSPLIT = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]|<\|")
#: A word up to a definite end of it, or a run without white space; with the white space before.
CHUNKS = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,!*#%&$|]|$)|[ \n]*[^ \n]+|[ \n]+")
RUN = re.compile(r"(?<=[^ \n])[ \n]")


# ------------------------------------------------------------------ tokenising

class ChunkEncoder:
    """Ids of texts by a byte-level BPE of the tokenizers library, which sees each distinct chunk once.

    Such a tokenizer never joins across the begin of a white-space run, nor a letter with a mark behind it (but for an
    apostrophe), so a text may be cut there; chunks repeat, and their ids are kept. Two generations of at most ``kept`` chunks
    are held: when the young one is full it becomes the old one, from which chunks still in use come back.
    """

    def __init__(self, path: str, kept: int = 600_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kept, self.young, self.old = kept, {}, {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str | None, piece: int = 1 << 20) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if UNSPLIT.search(text):
            return self._plain([text])[0]
        out, at = [], 0
        while at < len(text):
            cut = RUN.search(text, at + piece) if len(text) - at > piece else None
            stop = cut.start() if cut else len(text)
            out.append(self._piece(text[at:stop]))
            at = stop
        return b"".join(out)

    def _piece(self, text: str) -> bytes:
        chunks = CHUNKS.findall(text)
        try:
            return b"".join([self.young[c] for c in chunks])
        except KeyError:
            missing = {c for c in chunks if c not in self.young}
            if len(self.young) + len(missing) > self.kept:
                self.old, self.young, missing = self.young, {}, set(chunks)
            self.young.update((c, self.old[c]) for c in missing if c in self.old)
            unknown = [c for c in missing if c not in self.old]
            self.young.update(zip(unknown, self._plain(unknown)))
            return b"".join([self.young[c] for c in chunks])


@functools.lru_cache(maxsize=2)
def encoder(path: str, kept: int) -> ChunkEncoder:
    return ChunkEncoder(path, kept)


# ------------------------------------------------------------------ Elias-Fano

def encode_boundaries(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(low bits, samples, lower, upper) of an ascending sequence."""
    ends = np.asarray(ends, np.uint64)
    n, universe = len(ends), int(ends[-1]) if len(ends) else 0
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    shifts = np.arange(low, dtype=np.uint64)
    lower = np.packbits(((ends[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
    at = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    bits[at] = 1
    return low, at[::SAMPLE].astype("<u4").tobytes(), lower, np.packbits(bits, bitorder="little").tobytes()


class Boundaries:
    """Ends of documents in their encoded form."""

    def __init__(self, n: int, low: int, samples: np.ndarray, lower: np.ndarray, upper: np.ndarray):
        self.n, self.low, self.samples, self.lower, self.upper = n, low, samples, lower, upper

    def _select(self, i: int) -> int:
        """Position of set bit i: from the sample before it, bytes are skipped by their bit counts."""
        at = int(self.samples[i // SAMPLE])
        todo, byte = i % SAMPLE, at // 8
        first = self.upper[byte : byte + 1] & np.uint8(0xFF << (at % 8) & 0xFF)
        span = 64
        while True:
            run = np.concatenate([first, self.upper[byte + 1 : byte + span]])
            counts = np.cumsum(np.bitwise_count(run), dtype=np.int64)
            k = int(np.searchsorted(counts, todo, side="right"))
            if k < len(counts):
                rest = todo - (int(counts[k - 1]) if k else 0)
                return (byte + k) * 8 + int(np.flatnonzero(np.unpackbits(run[k : k + 1], bitorder="little"))[rest])
            span *= 4

    def end(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        high, at = self._select(i) - i, i * self.low
        bits = np.unpackbits(self.lower[at // 8 : (at + self.low + 7) // 8], bitorder="little")[at % 8 : at % 8 + self.low]
        return (high << self.low) | int(bits.astype(np.int64) @ (1 << np.arange(self.low)))

    def ends(self, block: int = 1 << 16) -> Iterator[np.ndarray]:
        """All ends in order, a block of documents at a time."""
        for at in range(0, self.n, block):
            yield np.fromiter((self.end(i) for i in range(at, min(self.n, at + block))), np.int64)


# ------------------------------------------------------------------ files

def pack(doc_ids: list[int | None], ids: list[bytes], id_bytes: int) -> bytes:
    """One file from documents' ids (unsigned 32-bit, little-endian)."""
    ends = np.cumsum([len(x) // 4 for x in ids])
    low, samples, lower, upper = encode_boundaries(ends)
    array = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{id_bytes}")
    nulls = sum(d is None for d in doc_ids)
    header = HEADER.pack(MAGIC, len(ids), len(array), low, id_bytes, nulls, len(samples) // 4)
    return b"".join([header, samples, lower, upper, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), array.tobytes()])


def unpack(data: bytes) -> tuple[Boundaries, np.ndarray, int, np.ndarray]:
    """(boundaries, doc ids, how many of the first are null, ids) as views of the file's bytes."""
    magic, n, total, low, id_bytes, nulls, samples = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    raw, at = np.frombuffer(data, np.uint8), HEADER.size
    sample = np.frombuffer(data, "<u4", samples, at)
    at += 4 * samples
    lower = raw[at : at + (n * low + 7) // 8]
    at += len(lower)
    ids_at = len(raw) - total * id_bytes
    upper = raw[at : ids_at - 8 * n]
    return Boundaries(n, low, sample, lower, upper), np.frombuffer(data, "<i8", n, ids_at - 8 * n), nulls, np.frombuffer(data, f"<u{id_bytes}", total, ids_at)


def write(documents: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, file_bytes: int = 8 << 20, kept: int = 600_000) -> tuple[str, DataFrame]:
    """Write every text (null: empty) with ``end_id`` behind it; returns (folder, manifest).

    ``folder`` has to be reachable from all executors; by default a new one below the shared folder. ``file_bytes`` bounds the
    ids that a task holds, but for a single longer document, ``kept`` the chunks that a Python worker remembers (time for
    memory; ids are the same). Ties of ids fall by text, nulls come first.
    """
    folder = folder or work_path(documents.sparkSession, "token-files")
    ordered = documents.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc())
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer, kept)
        store, root = fs.FileSystem.from_uri(folder)
        doc_ids, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, ids, held, number
            name = f"{root}/part-{part:06d}-{number:05d}.eft"
            passing = f"{name}.{uuid.uuid4().hex}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(passing) as out:
                out.write(pack(doc_ids, ids, coder.id_bytes))
            store.move(passing, name)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "path": [os.path.basename(name)], "documents": pa.array([len(ids)], pa.int64()), "ids": pa.array([held // 4], pa.int64())})
            doc_ids, ids, held, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_ids.append(doc_id.as_py())
                ids.append(coder.encode(text.as_py()) + end)
                held += len(ids[-1])
                if held >= file_bytes:
                    yield flush()
        if ids:
            yield flush()

    return folder, stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read(folder: str, manifest: DataFrame, release: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the files in ``manifest``; start counts ids from the first file's begin.
    With ``release`` the reading workers drop the tokenizers and chunks that they remember from writing."""
    spark = manifest.sparkSession
    parts = stored(manifest.groupBy("part").agg(F.sum("ids").alias("n")), "token-parts")  # one row for each task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("own", F.coalesce(F.sum("ids").over(inside), F.lit(0).cast("long"))).join(sized(stored(before, "token-starts")), "part")
    files = placed.select("path", (F.col("own") + F.col("part_start")).alias("start")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if release:
            encoder.cache_clear()
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                with store.open_input_file(f"{root}/{path}") as file:
                    boundaries, doc_ids, nulls, ids = unpack(file.read())
                at, done = 0, 0
                for ends in boundaries.ends():
                    starts = np.concatenate([[at], ends[:-1]])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                    names = pd.Series(doc_ids[done : done + len(ends)], dtype="Int64")
                    names[: max(0, nulls - done)] = pd.NA
                    yield pd.DataFrame({"doc_id": names, "start": start + starts, "n_tokens": ends - starts, "ids_crc32": np.array(crc, np.int64)})
                    at, done = int(ends[-1]), done + len(ends)

    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(documents: DataFrame, tokenizer: str, release: bool = False, **how) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), one for each row of ``documents``, read back from the files written.

    Null and empty texts are the end id alone. Only doc_id and text are read, so further columns may have any name.
    Repeated rows and ids are written as often as given, null ids first. An empty table writes no file and gives no rows.
    ``release``: see ``read``.
    """
    return read(*write(documents, tokenizer, **how), release)
