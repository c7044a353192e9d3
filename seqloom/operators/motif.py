"""Windows next to a motif: guides of a sequence table, and all sites of an index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.common import quoted
from seqloom.functions import sequence as sq


@dataclass(frozen=True)
class Enzyme:
    """A motif (PAM), the length of the guide beside it, and the side it lies on."""

    pam: str
    length: int
    five_prime: bool = False

    def __post_init__(self):
        if self.length < 1 or self.length + len(self.pam) > 28 or not self.pam:
            raise ValueError("guide and motif must have 1 to 28 bases together")
        sq.expand_motif(self.pam)

    @property
    def site(self) -> int:
        return self.length + len(self.pam)


# fixed values: enzymes known by name
PRESETS = {"spcas9-ngg": Enzyme("NGG", 20), "spcas9-nag": Enzyme("NAG", 20), "spcas9-nrg": Enzyme("NRG", 20), "cas12a-tttn": Enzyme("TTTN", 23, True)}


def chunks(df: DataFrame, contig: str, sequence: str, size: int, overlap: int) -> DataFrame:
    """Fixed-size pieces of contigs: ``contig``, ``chunk_no``, ``chunk_start`` (0-based), ``core``, ``seq_start`` and ``seq``, which reaches ``overlap`` bases to either side of the core.

    One regular expression walks over a contig once and takes overlapping
    pieces as it goes, so the cost grows with the contig's length only.  Null
    and empty sequences give no row.  Contigs in files are better read in
    chunks (:func:`seqloom.sources.readers.fasta_chunks`).
    """
    n = F.length(quoted(sequence)).cast("long")
    padded = F.concat(F.lit("." * overlap), quoted(sequence))
    taken = F.regexp_extract_all(padded, F.lit("(?s)(?=(.{1,%d})).{1,%d}" % (size + 2 * overlap, size)), F.lit(1))
    pieces = df.where(n > 0).select(quoted(contig).alias("contig"), n.alias("__n"), F.posexplode(taken).alias("chunk_no", "__t"))
    start = F.col("chunk_no").cast("long") * size
    left = F.least(F.lit(overlap).cast("long"), start)
    return pieces.where(start < F.col("__n")).select("contig", "chunk_no", start.alias("chunk_start"), F.least(F.lit(size), F.col("__n") - start).cast("int").alias("core"), (start - left).alias("seq_start"), F.substring(F.col("__t"), (F.lit(overlap + 1) - left).cast("int"), F.lit(2**31 - 1)).alias("seq"))


#: Bases looked at at once: bounds the memory of a scan, whatever the length of a sequence.
SLICE = 1 << 21
_UPPER, _BITS, _OTHER = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
for _bit, (_base, _pair) in enumerate(("AT", "CG", "GC", "TA")):
    for _case in (str.upper, str.lower):
        _BITS[ord(_case(_base))] = 1 << _bit
    _OTHER[ord(_base)] = ord(_pair)


def _bits(motif: str) -> list[int]:
    """The bases that each letter of a motif stands for, one bit each."""
    return [sum(1 << "ACGT".index(b) for b in sq.IUPAC[c]) for c in motif.upper()]


def _texts(rows: np.ndarray) -> pa.Array:
    """Strings of one length from an array of their letters."""
    n, width = rows.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows)))


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all sequences one after another, and where each starts (and the end); letters outside ASCII count as one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.concat_arrays([column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())])
    for _ in range(2):
        offsets = np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1, binary.offset * 8)
        data = np.frombuffer(binary.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        if not len(data) or data.max() < 128:
            break
        binary = pa.array([s.decode("utf-8", "replace").encode("ascii", "replace") for s in binary.to_pylist()], pa.large_binary())
    return data, offsets - offsets[0]


def sites(df: DataFrame, sequence: str, enzyme: Enzyme, keep: tuple[str, ...] = (), pure: bool = True, around: tuple[int, int] | None = None, start: str | None = None, core: tuple[str, str] | None = None) -> DataFrame:
    """All motif-flanked sites on both strands: ``keep`` columns, ``offset`` (0-based, leftmost forward base), ``strand``, ``site`` (motif and guide as the enzyme reads them).

    Sites may overlap.  ``pure`` leaves out sites with letters other than ACGT.
    With ``around`` there is also a column of that name: the guide with so many
    bases before and behind it, read along its strand, null where they leave
    the sequence.  ``start`` names a column with the place of a sequence's
    first base (0 if not given); ``core`` names two with a start and a length
    within which a site must begin, so overlapping chunks give no site twice.
    Null and empty sequences give no row.

    All sequences of an Arrow batch are one array of letters: a motif is found
    by a few vector operations a base, windows are made for matches only.  The
    cost grows with the number of bases, and memory with ``SLICE``.
    """
    k, p, guide = enzyme.site, len(enzyme.pam), enzyme.length
    forward, backward = _bits(enzyme.pam), _bits(sq.reverse_motif(enzyme.pam))
    plus_at, minus_at = (0, guide) if enzyme.five_prime else (guide, 0)
    fields = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField("offset", T.LongType()), T.StructField("strand", T.StringType()), T.StructField("site", T.StringType())] + ([T.StructField("around", T.StringType())] if around else [])

    def strand_hits(data: np.ndarray, codes: np.ndarray, first: int, bounds: np.ndarray, plus: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the sites of one strand, their sequences' numbers and their letters."""
        n = len(codes) - k + 1
        at = plus_at if plus else minus_at
        found = np.ones(n, bool)
        for j, want in enumerate(forward if plus else backward):
            if want != 15:
                found &= (codes[at + j : at + j + n] & want) != 0
        hits = np.flatnonzero(found) + first
        row = np.searchsorted(bounds, hits, "right") - 1
        inside = hits + k <= bounds[row + 1]
        hits, row = hits[inside], row[inside]
        letters = data[hits[:, None] + np.arange(k)]
        if pure:
            clean = (_BITS[letters] != 0).all(1)
            hits, row, letters = hits[clean], row[clean], letters[clean]
        letters = _UPPER[letters]
        return hits, row, letters if plus else _OTHER[letters[:, ::-1]]

    def surroundings(data: np.ndarray, hits: np.ndarray, row: np.ndarray, bounds: np.ndarray, plus: bool) -> pa.Array:
        before, behind = around
        first = hits + ((p if plus else 0) if enzyme.five_prime else (0 if plus else p)) - (before if plus else behind)
        width = before + guide + behind
        ok = (first >= bounds[row]) & (first + width <= bounds[row + 1])
        letters = _UPPER[data[np.where(ok, first, 0)[:, None] + np.arange(width) * ok[:, None]]] if len(hits) else np.empty((0, width), np.uint8)
        return pa.compute.if_else(pa.array(ok), _texts(letters if plus else _OTHER[letters[:, ::-1]]), pa.scalar(None, pa.string()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _letters(batch.column(len(keep)))
            more = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keep) + 1, batch.num_columns)]
            for first in range(0, len(data) - k + 1, SLICE):
                codes = _BITS[data[first : first + SLICE + k - 1]]
                for plus in (True, False):
                    hits, row, letters = strand_hits(data, codes, first, bounds, plus)
                    offset = hits - bounds[row] + (more[0][row].astype(np.int64) if start else 0)
                    if core:
                        low = more[-2][row].astype(np.int64)
                        kept = (offset >= low) & (offset < low + more[-1][row].astype(np.int64))
                        hits, row, letters, offset = hits[kept], row[kept], letters[kept], offset[kept]
                    if not len(hits):
                        continue
                    out = [batch.column(i).take(pa.array(row)) for i in range(len(keep))] + [pa.array(offset.astype(np.int64)), pa.array(np.full(len(hits), "+" if plus else "-")).cast(pa.string()), _texts(letters)]
                    yield pa.RecordBatch.from_arrays(out + ([surroundings(data, hits, row, bounds, plus)] if around else []), names=[f.name for f in fields])

    used = [*(quoted(c).alias(f"k{i}") for i, c in enumerate(keep)), quoted(sequence).alias("__s")] + [quoted(c).cast("long") for c in ([start] if start else [])] + [quoted(c).cast("long") for c in (core or ())]
    found = df.where(F.length(quoted(sequence)) >= k).select(*used).mapInArrow(scan, T.StructType(fields))
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "offset", "strand", "site", *(["around"] if around else []))


def protospacer(site: Column, enzyme: Enzyme) -> Column:
    return F.substring(site, len(enzyme.pam) + 1, enzyme.length) if enzyme.five_prime else F.substring(site, 1, enzyme.length)


def motif_of(site: Column, enzyme: Enzyme) -> Column:
    return F.substring(site, 1, len(enzyme.pam)) if enzyme.five_prime else F.substring(site, enzyme.length + 1, len(enzyme.pam))


def guides(df: DataFrame, contig: str, sequence: str, enzyme: Enzyme, context: tuple[int, int] = (4, 6), cut: tuple[int, int] = (-4, -4), start: str | None = None, core: tuple[str, str] | None = None) -> DataFrame:
    """Guides with their place: ``contig``, ``guide``, ``pam``, ``position``, ``sense``, ``context``, protospacer range and cut-site range.

    ``position`` is 1-based: for a 3' motif the protospacer's first base on +,
    the motif's first forward base on -; for a 5' motif the first forward base
    of the motif.  ``start``/``stop`` is the protospacer, 0-based half-open,
    ``cut_start``/``cut_stop`` the cut site at ``cut`` bases from the
    protospacer's end next to the motif (negative: inside for 3' motifs).
    Windows whose context leaves the sequence or holds other letters than ACGT
    are left out.  ``start`` and ``core`` name the columns of a chunk's place
    as in :func:`sites`; chunks must overlap by the context.
    """
    p, k = len(enzyme.pam), enzyme.length
    left, right = context
    # the context surrounds the protospacer; a 5' motif lies inside it as well
    found = sites(df, sequence, enzyme, (contig,), around=(left + p, right) if enzyme.five_prime else (left, right), start=start, core=core)
    plus = F.col("strand") == "+"
    spacer = F.col("offset") + F.when(plus, p if enzyme.five_prime else 0).otherwise(0 if enzyme.five_prime else p)
    rows = found.where(F.col("around").rlike("^[ACGT]+$")).withColumn("__spacer", spacer)
    motif_at = F.col("offset") + F.when(plus, 0 if enzyme.five_prime else k).otherwise(k if enzyme.five_prime else 0)
    if enzyme.five_prime:
        position = motif_at + 1
        edge = F.when(plus, F.col("__spacer")).otherwise(F.col("__spacer") + k)
    else:
        position = F.when(plus, F.col("__spacer")).otherwise(motif_at) + 1
        edge = F.when(plus, F.col("__spacer") + k).otherwise(F.col("__spacer"))
    a = F.when(plus, edge + cut[0]).otherwise(edge - cut[1])
    b = F.when(plus, edge + cut[1]).otherwise(edge - cut[0])
    return rows.select(
        quoted(contig).alias("contig"), protospacer(F.col("site"), enzyme).alias("guide"), motif_of(F.col("site"), enzyme).alias("pam"), position.cast("long").alias("position"), F.col("strand").alias("sense"),
        F.col("around").alias("context"), F.col("__spacer").cast("long").alias("start"), (F.col("__spacer") + k).cast("long").alias("stop"), a.cast("long").alias("cut_start"), b.cast("long").alias("cut_stop"),
    )


#: Names of a chunk's columns in :func:`chunks` and the reader of the same name, as arguments of :func:`sites` and :func:`guides`.
CHUNKED = {"start": "seq_start", "core": ("chunk_start", "core")}


def packed_id(rows: DataFrame) -> Column:
    """The composite id of text files: id,guide,pam,contig,position,sense."""
    name = F.concat_ws(":", "contig", F.col("position").cast("string"), "sense")
    return F.concat_ws(",", name, "guide", "pam", "contig", F.col("position").cast("string"), "sense")


def tile_ranges(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """Ranges cut into tasks of at most ``size``: ``task_start``, ``task_end``."""
    at = df.where(quoted(start) < quoted(end)).withColumn("task_start", F.explode(F.sequence(quoted(start), quoted(end) - 1, F.lit(size).cast("long"))))
    return at.withColumn("task_end", F.least(quoted(end), F.col("task_start") + size))
