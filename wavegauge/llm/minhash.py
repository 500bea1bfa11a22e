"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard on full shingle sets.

Two permutations of a 32-bit universe make the whole signature: the first scatters the shingle
hashes, the second is shifted circularly by one stride for each coordinate and applied to them. Bands of the
signature name buckets. Within buckets, documents are first joined to the smallest one by their
signatures; where a bucket still holds unconnected documents, they are compared block by block. What
hangs together by signature forms a group, and inside the groups links are confirmed on the full
sets. A link is only looked for between parts of a group not yet connected, so a group of copies
costs about one confirmation for each text, and no step lists all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import connected_components
from .frames import block_pairs, group_tables, parallelism
from .text import Texts, byte_hashes, mix64, shingles, slices, words

# A pair at Jaccard 0.8 shares none of the bands with a chance of (1 - 0.8^5)^36 = 6e-7.
BANDS, ROWS = 36, 5
STRIDE = 0x9E3779B9
# Signatures agree by 8 bits of each coordinate; pairs this many standard deviations below are not confirmed.
SLACK = 5.0
# Documents of a bucket, and documents and text bytes of a group, that one task compares.
BUCKET_BLOCK, GROUP_BLOCK, GROUP_BYTES = 2048, 1024, 16 << 20


def _permute(z: np.ndarray, spare: np.ndarray, c1: int, c2: int) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    for shift, c in ((16, c1), (13, c2)):
        np.right_shift(z, np.uint32(shift), out=spare)
        np.bitwise_xor(z, spare, out=z)
        np.multiply(z, np.uint32(c), out=z)
    np.right_shift(z, np.uint32(16), out=spare)
    return np.bitwise_xor(z, spare, out=z)


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash signatures (sets x coordinates, 32 bit) of non-empty sets of 64-bit hashes."""
    out = np.empty((len(sets), coordinates), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= 1 << 15):
            n += len(sets[hi])
            hi += 1
        first = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        z = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        spare, shifted = np.empty_like(z), np.empty_like(z)
        z = _permute(z, spare, 0x85EBCA6B, 0xC2B2AE35)
        for k in range(coordinates):
            np.add(z, np.uint32(k * STRIDE & 0xFFFFFFFF), out=shifted)
            out[lo:hi, k] = np.minimum.reduceat(_permute(shifted, spare, 0x7FEB352D, 0x846CA68B), first)
        lo = hi
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for every band, different for each band."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = mix64(h ^ sig[:, b * rows + r].astype(np.uint64))
        out[:, b] = h
    return out


def text_sets(t: Texts, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, start, length, first = words(t)
    h, offsets = shingles(byte_hashes(data, start, length), first, k)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        s = np.sort(h[a:b])
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column("text")):
                sets = text_sets(t, k)
                full = [s for s in sets if len(s)]
                sig = signatures(full)
                keys, low = iter(band_keys(sig).view(np.int64).tolist()), iter((sig & np.uint32(255)).astype(np.uint8))
                rows = [(next(keys), next(low).tobytes(), hashlib.blake2b(s.tobytes(), digest_size=16).digest()) if len(s) else (None, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(t.first, t.count),
                        b.column("version").slice(t.first, t.count),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                        pa.array([r[1] for r in rows], pa.binary()),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    ["doc_id", "version", "n", "bands", "sig", "digest"],
                )

    return run


def least_matches(threshold: float, coordinates: int = BANDS * ROWS, slack: float = SLACK) -> int:
    """Coordinates that agree at least, for a pair at the threshold, but for ``slack`` standard deviations."""
    return int(coordinates * threshold - slack * (coordinates * threshold * (1 - threshold)) ** 0.5)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


class Union:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _near_in_bucket(least: int):
    """Edges that connect different labels of a bucket by signature, enough to span what hangs together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_tables(batches, ["key", "pair"]):
            rep, label = np.asarray(table["rep"]), np.unique(np.asarray(table["label"]), return_inverse=True)[1]
            sig = _sigs(table["sig"].combine_chunks())
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(np.asarray(table["group"]))) + 1, [len(rep)]))
            out_a, out_b = [], []
            sizes = np.diff(cuts)
            for n in np.unique(sizes[sizes <= 8]):  # small groups of one size at once
                at = cuts[:-1][sizes == n]
                for i in range(n):
                    for j in range(i + 1, n):
                        ok = (label[at + i] != label[at + j]) & ((sig[at + i] == sig[at + j]).sum(1) >= least)
                        out_a.append(rep[at[ok] + i])
                        out_b.append(rep[at[ok] + j])
            for a, n in zip(cuts[:-1][sizes > 8], sizes[sizes > 8]):
                sets = Union(int(label.max()) + 1)
                mine, own = label[a : a + n], sig[a : a + n]
                for i in range(1, n):
                    other = np.flatnonzero((own[:i] == own[i]).sum(1) >= least)
                    near, at = np.unique(mine[other], return_index=True)
                    for x, j in zip(near.tolist(), other[at].tolist()):
                        if sets.join(int(mine[i]), x):
                            out_a.append(rep[[a + i]])
                            out_b.append(rep[[a + j]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def exact_links(sets: list[np.ndarray], sig: np.ndarray, percent: int, least: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Confirmed links that span the components of the sets, tried from the likeliest down."""
    n = len(sets)
    found = Union(n)
    size = np.array([len(s) for s in sets])
    links = []
    order = np.argsort(size, kind="stable")
    for p in range(1, n):
        i = order[p]
        before = order[:p]
        fits = before[size[before] * 100 >= percent * size[i]]
        match = (sig[fits] == sig[i]).sum(1)
        likely = match >= least
        for j in fits[likely][np.argsort(-match[likely], kind="stable")]:
            if found.root(int(i)) != found.root(int(j)):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    found.join(int(i), int(j))
                    links.append((int(i), int(j)))
    return links


def _confirm(k: int, percent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_tables(batches, ["grp", "pair"], 2000):
            group = np.asarray(table["group"])
            texts = table["text"].combine_chunks()
            sets = [s for t in slices(texts) for s in text_sets(t, k)]
            sig = _sigs(table["sig"].combine_chunks())
            doc = np.asarray(table["doc"])
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(doc)]))
            links = [(a + i, a + j) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1 for i, j in exact_links(sets[a:b], sig[a:b], percent, least)]
            if links:
                at = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(doc[at[:, 0]]), pa.array(doc[at[:, 1]])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose word k-shingle sets have a Jaccard similarity of ``percent`` or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than k words has its whole
    sequence as the only shingle, one without words an empty set that links with nothing. Returns
    doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included), kept (doc_id =
    component_id).

    Rows with the same doc_id are one document, linked by any of its texts. Rows without doc_id link
    with nothing: component_id is NULL and kept true. NULL text is empty. An empty table gives no
    rows; other columns are ignored. doc_id is an integer.
    """
    least = least_matches(percent / 100)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    sketch = materialise(base.mapInArrow(_sketch(k), "doc_id long, version long, n long, bands array<long>, sig binary, digest binary"), "sketch")
    some = sketch.where("n > 0 and doc_id is not null")
    # One row for each different set: a number of its own (one document may hold several sets), fixed by
    # the written table, and the document of the smallest id.
    reps = some.groupBy("digest").agg(F.min(F.struct("doc_id", "version", "bands", "sig")).alias("x"))
    reps = materialise(reps.select("digest", F.monotonically_increasing_id().alias("rep"), F.col("x.doc_id").alias("doc"), "x.version", "x.bands", "x.sig"), "reps")
    members = materialise(some.select("doc_id", "digest").join(reps.select("digest", F.col("doc").alias("rep")), "digest").select("doc_id", "rep", "digest").distinct(), "members")
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count("*").alias("size")).where("lead < last")
    crowded = materialise(buckets.join(leaders.select("key", "lead", "size"), "key"), "buckets")
    sigs = reps.select("rep", "sig")
    stars = crowded.where("lead <> rep").select("lead", "rep").distinct()
    stars = stars.join(sigs, "rep").join(sigs.select(F.col("rep").alias("lead"), F.col("sig").alias("sig2")), "lead")
    stars = materialise(stars.mapInArrow(_near_stars(least), "a long, b long"), "stars")
    first = connected_components(stars)
    labelled = crowded.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    apart = labelled.join(mixed, "key", "left_semi").join(sigs, "rep")
    pairs = block_pairs(apart.withColumn("blocks", F.col("size") / F.lit(BUCKET_BLOCK)), "rep", "blocks").select("key", "pair", "rep", "label", "sig")
    parts = parallelism(docs)
    dealt = pairs.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", "rep")
    more = dealt.mapInArrow(_near_in_bucket(least), "a long, b long")
    groups = materialise(connected_components(stars.unionAll(more)), "groups")
    # Confirm within groups, on texts.
    texts = base.join(reps.select("rep", F.col("doc").alias("doc_id"), "version", "sig").join(groups.withColumnRenamed("node", "rep"), "rep"), ["doc_id", "version"])
    texts = texts.groupBy("rep").agg(F.first("doc_id").alias("doc"), F.first("text").alias("text"), F.first("sig").alias("sig"), F.first("component").alias("grp"))
    texts = materialise(texts, "texts")
    sizes = texts.groupBy("grp").agg(F.greatest(F.count("*") / F.lit(GROUP_BLOCK), F.sum(F.octet_length("text")) / F.lit(GROUP_BYTES)).alias("blocks"))
    sized = block_pairs(texts.join(sizes, "grp"), "rep", "blocks").select("grp", "pair", "rep", "doc", "text", "sig")
    dealt = sized.repartition(parts, "grp", "pair").sortWithinPartitions("grp", "pair", "rep")
    links = dealt.mapInArrow(_confirm(k, percent, least), "a long, b long")
    repeated = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id").join(members, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = connected_components(links.unionAll(repeated)).withColumnRenamed("node", "rep").withColumnRenamed("component", "found")
    named = members.join(final, "rep", "left").select("doc_id", "digest", F.coalesce("found", "rep").alias("component"))
    out = sketch.select("doc_id", "n", "digest").join(named, ["doc_id", "digest"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _near_stars(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = pa.array((_sigs(b.column("sig")) == _sigs(b.column("sig2"))).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([b.column("lead").filter(ok), b.column("rep").filter(ok)], ["a", "b"])

    return run
