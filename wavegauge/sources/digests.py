"""SHA-256 of long files, piece by piece: the running state passes from task to task."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 256 << 20  # bytes that one task reads of a long file
UNPACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")  # Spark's reader of lines unpacks files of these names
BOM = b"\xef\xbb\xbf"  # a file's first bytes that this reader drops
STATE = "state binary, n long, start long"


@lru_cache(maxsize=1)
def _openssl():
    """The OpenSSL of hashlib, whose objects keep their state to themselves; SHA256_CTX of its C interface is plain bytes."""
    import _hashlib

    for name in (getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")):
        lib = ctypes.CDLL(name) if name else None
        if hasattr(lib, "SHA256_Update"):
            lib.SHA256_Init.argtypes = [ctypes.c_void_p]
            lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
            lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
            return lib
    raise OSError("SHA-256 in pieces needs the shared library libcrypto")


class Sha256:
    """SHA-256 that can go on from the state of another one (same byte order)."""

    def __init__(self, state: bytes | None = None):
        self.ctx = ctypes.create_string_buffer(state or bytes(112), 112)  # sizeof(SHA256_CTX): 8 + 2 + 16 + 2 ints
        if state is None:
            _openssl().SHA256_Init(self.ctx)

    def update(self, data: bytes | np.ndarray) -> None:
        at = data.ctypes.data if isinstance(data, np.ndarray) else data
        _openssl().SHA256_Update(self.ctx, at, len(data))

    def state(self) -> bytes:
        return self.ctx.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        _openssl().SHA256_Final(out, ctypes.create_string_buffer(self.ctx.raw, 112))
        return out.raw.hex()


def _go_on(state: bytes, n: int, start: int):
    """From the state before a piece to the one behind it; n counts the bytes of all lines so far.

    The line feed of the last line waits for the next line, as a file may end without one.
    """

    def run(batches):
        h, seen, last = Sha256(state), n, start
        for b in batches:
            if b.num_rows == 0:
                continue
            starts = b.column("start").to_numpy()
            if starts[0] < last or (np.diff(starts) < 0).any():
                raise ValueError("the pieces of a file came out of order")
            lines = b.column("line").cast(pa.large_binary())  # their bytes lie one behind the other
            ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
            if seen:
                h.update(b"\n")
            h.update(np.frombuffer(lines.buffers()[2], np.uint8)[ends[0] : ends[-1] - 1])
            seen, last = seen + int(ends[-1] - ends[0]), int(starts[-1])
        yield pa.RecordBatch.from_arrays([pa.array([h.state()]), pa.array([seen]), pa.array([last])], ["state", "n", "start"])

    return run


def escape_glob(path: str) -> str:
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _lines(spark: SparkSession, path: str, piece: int) -> DataFrame:
    """The bytes of a file as lines with their line feeds, one partition per piece; a line belongs to the piece it begins in."""
    s = spark.newSession()  # the size of a piece is a setting of the session
    for k, v in spark.conf.getAll.items():
        if not k.startswith("spark."):  # options of file systems
            s.conf.set(k, v)
    s.conf.set("spark.sql.files.maxPartitionBytes", str(piece))
    s.conf.set("spark.sql.files.minPartitionNum", "1")
    d = s.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(escape_glob(path))
    return d.select(F.col("_metadata.file_block_start").alias("start"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))


def sha256_in_pieces(spark: SparkSession, path: str, size: int, piece: int = PIECE) -> str:
    """SHA-256 of one file of ``size`` bytes; each task reads one piece and hands on 112 bytes of state.

    The chain over a file has no parallel form, so its pieces run one after the other. A line longer than a piece is read whole.
    """
    lines = _lines(spark, path, piece)
    for head in (b"", BOM):
        h = Sha256()
        h.update(head)
        state, n, start, k, pieces = h.state(), 0, 0, 0, 1
        while k < pieces:
            step = lines.mapInArrow(_go_on(state, n, start), STATE).rdd
            pieces = step.getNumPartitions()
            (r,) = spark.sparkContext.runJob(step, list, [k])
            state, n, start, k = bytes(r["state"]), r["n"], r["start"], k + 1
        left = size - len(head) - n
        if left in (0, -1):  # -1: the file ends without a line feed
            h = Sha256(state)
            h.update(b"\n" * (left == 0 and n > 0))
            return h.hexdigest()
    raise ValueError(f"{path} has {size} bytes, but its lines have {n}")
