"""Helpers that several text operators share."""

from __future__ import annotations

import os
import uuid

import numpy as np
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroflow.session import scratch_path, shared_dir, write_and_read  # noqa: F401  re-exported

#: White space between words, the same set in every operator that counts words.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_is(doc_id: str, parts: int, part: int) -> Column:
    """crc32(doc_id as text) mod parts = part; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    if not text:
        return []
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    found = text.split()
    if sum(map(len, found)) + sum(map(text.count, " \t\n\r\x0b\x0c")) == len(text):
        return found
    for c in "\t\n\r\x0b\x0c":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, with A-Z in lower case and nothing else changed."""
    return text.encode().lower().split() if text else []


_IN_USE: list[dict] = []


def claim(table: dict) -> None:
    """Let go of the word table that another step has left in this worker: workers are reused, and hold one at a time."""
    if not _IN_USE or _IN_USE[0] is not table:
        if _IN_USE:
            _IN_USE[0].clear()
        _IN_USE[:] = [table]


class Bounded(dict):
    """What a worker has found out about words, up to ``most_bytes``, about; words met after that are not kept."""

    #: Bytes of an entry besides its word, about.
    ENTRY = 180

    def __init__(self, most_bytes: int = 64_000_000):
        super().__init__()
        self.most_bytes, self.held = most_bytes, 0

    def keep(self, word, found) -> None:
        if self.held < self.most_bytes:
            self[word] = found
            self.held += len(word) + self.ENTRY

    def clear(self) -> None:
        super().clear()
        self.held = 0


class WordHashes(Bounded):
    """A 64-bit hash per word; ``least`` keeps small numbers free for other uses."""

    def __init__(self, least: int = 0):
        super().__init__()
        self.least = least

    def __missing__(self, word: bytes) -> int:
        found = max(self.least, xxhash.xxh3_64_intdigest(word))
        self.keep(word, found)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        claim(self)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class SharedFolder:
    """Files below the shared folder, written and read inside tasks by any executor."""

    def __init__(self, uri: str):
        self.uri = uri

    def _at(self):
        return fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else
                                      "file://" + os.path.abspath(self.uri))

    def write(self, name: str, data: bytes, fixed: bool = False) -> str:
        """Write a file and return its name, which no other file has.

        ``fixed`` keeps the given name: for files whose content a repeated task makes again byte for byte.
        The file is put in place whole in either case.
        """
        files, base = self._at()
        files.create_dir(base, recursive=True)
        path = f"{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(f"{base}/{path}", compression=None) as out:
            out.write(data)
        if not fixed:
            return path
        if files.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
            files.move(f"{base}/{path}", f"{base}/{name}")
        else:
            files.delete_file(f"{base}/{path}")
        return name

    def read(self, path: str) -> bytes:
        files, base = self._at()
        with files.open_input_stream(f"{base}/{path}", compression=None) as src:
            return src.read()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def squeezed(x: np.ndarray) -> bytes:
    """Rising 64-bit numbers as differences, bytes of the same rank side by side, which Spark's compression likes."""
    return np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueezed(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def small(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, laid out as in ``squeezed``."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unsmall(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
