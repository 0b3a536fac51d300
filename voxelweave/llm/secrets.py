"""Secret scans: patterns of well-known secrets, and strings that zstandard finds new.

The base finds assignments to secret names, access keys and long hexadecimal runs by pattern. Beyond them, candidates are long runs
of key characters of two kinds of characters at least, shortly after a word that announces a secret. A candidate's novelty is the
number of bytes that it adds to its surroundings once compressed, for each of its own bytes: the text around it is compressed with
and without it by zstandard, primed with a dictionary of the identifiers of all documents. Names, paths and words repeat parts of
either and add little; random strings add almost all of their bytes and are reported.

The dictionary is a corpus statistic: the identifiers of most documents, counted over all of them and bounded by
``DICTIONARY_WORDS``. Identifiers have no digits, so a key that was copied often does not enter it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from voxelweave.llm.toxicity import slices

KINDS = ("assign", "access", "hex", "novel")
# The patterns of the base.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more; shorter ones hold no other start that is longer
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
ASSIGN_NAMES = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,200}(?![A-Za-z0-9+/_=-])")
SENSITIVE = ("key", "token", "secret", "passw", "auth", "bearer", "credential", "cookie", "session", "signature", "private", "access")
AHEAD = 48
AROUND = 400
NOVEL = 0.75

DICTIONARY_WORDS = 4_096
NOT_IDENTIFIER = r"[^A-Za-z_]+"


def identifiers(documents: DataFrame, words: int = DICTIONARY_WORDS, least: int = 2) -> list[str]:
    """The identifiers (letters and underscores, 4 to 40 of them) of most documents, at most ``words``; of equals the first by name."""
    each = documents.select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), NOT_IDENTIFIER))).alias("name"))
    counts = each.where(F.length("name").between(4, 40)).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [r["name"] for r in counts.orderBy(F.col("n").desc(), "name").limit(words).collect()]


def dictionary(names: list[str]) -> bytes:
    """Names from the rarest to the most common: what stands last is cheapest to point at."""
    return " ".join(reversed(names)).encode()


class Novelty:
    """Marginal compressed bytes of a string among its surroundings."""

    def __init__(self, content: bytes, level: int = 9) -> None:
        primed = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(content) >= 8 else {}
        self.compressor = zstandard.ZstdCompressor(level=level, **primed)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode()))

    def of(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        return (self.size(before + text[start:end] + after) - self.size(before + after)) / len(text[start:end].encode())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base, those that are too short dropped; positions are code points."""
    lowered = text.lower()
    found = []
    if any(name in lowered for name in ASSIGN_NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _kinds(token: str) -> int:
    return any("a" <= c <= "z" for c in token) + any("A" <= c <= "Z" for c in token) + any("0" <= c <= "9" for c in token)


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty, threshold: float = NOVEL) -> list[tuple[str, int, int]]:
    """Incompressible strings after a sensitive word that do not meet a span of the base."""
    if not any(word in text.lower() for word in SENSITIVE):
        return []
    taken, at = sorted((start, end) for _, start, end in base), 0
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end or _kinds(m[0]) < 2:
            continue
        ahead = text[max(0, start - AHEAD) : start].lower()
        if any(word in ahead for word in SENSITIVE) and novelty.of(text, start, end) >= threshold:
            found.append(("novel", start, end))
    return found


def find_secrets(text: str | None, novelty: Novelty, threshold: float = NOVEL) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty, threshold), key=lambda s: (s[1], KINDS.index(s[0])))


def scan(documents: DataFrame, names: list[str] | None = None, threshold: float = NOVEL) -> DataFrame:
    """Rows (doc_id, found: array of (kind, start, end)), one for each row of ``documents``; ends are exclusive, in code points.

    Only doc_id and text are read, so further columns may have any name. Null and empty texts have no spans. A null doc_id
    and repeated rows are kept; equal texts have equal spans. Texts of any length are read whole. An empty table gives no rows, and
    without common identifiers the surroundings alone prime the compressor.
    """
    content = dictionary(identifiers(documents) if names is None else names)
    shared = documents.sparkSession.sparkContext.broadcast(content)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(shared.value)
        for batch in slices(batches, 500):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py(), novelty, threshold)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) of ``scan``."""

    def told(kept: Column) -> Column:
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(told(F.filter("found", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
