"""Column expressions on nucleotide sequences; all run inside generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the IUPAC nucleotide codes
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# fixed values: weight of the two bases after a protospacer's first PAM base; all other pairs weigh 0
PAM_TAIL = {"GG": 1.0, "AG": 0.259259259, "CG": 0.107142857, "GA": 0.069444444, "TG": 0.038961039, "GC": 0.022222222, "GT": 0.016129032}
# fixed values: nearest-neighbour enthalpy and entropy of DNA duplexes (Allawi and SantaLucia 1997)
NEAREST = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "TG": (-8.5, -22.7),
    "GT": (-8.4, -22.4), "AC": (-8.4, -22.4), "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2),
    "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
# fixed values: free energy of RNA-DNA hybrids by dinucleotide (Sugimoto et al. 1995), and of initiation
HYBRID = {
    "AA": -1.0, "AC": -2.1, "AG": -1.8, "AT": -0.9, "CA": -0.9, "CC": -2.1, "CG": -1.7, "CT": -0.9,
    "GA": -1.3, "GC": -2.7, "GG": -2.9, "GT": -1.1, "TA": -0.6, "TC": -1.5, "TG": -1.6, "TT": -0.2,
}
HYBRID_START = 3.1
#: Low bit of every packed base.
LOW_BITS = 0x5555555555555555


def expand_motif(motif: str) -> list[str]:
    """All concrete sequences of an IUPAC motif, in the order of the codes; an unknown code is an error."""
    return ["".join(x) for x in product(*(IUPAC[c] for c in motif.upper()))]


def expanded(motif: Column) -> Column:
    """All concrete sequences of a column of IUPAC motifs as an array; other letters are left out, null gives null."""
    codes = F.create_map(*(F.lit(x) for k, v in IUPAC.items() for x in (k, v)))
    letters = F.filter(F.split(F.upper(motif), ""), lambda c: F.map_contains_key(codes, c))
    more = lambda made, c: F.flatten(F.transform(made, lambda m: F.transform(F.split(F.element_at(codes, c), ""), lambda b: F.concat(m, b))))
    return F.aggregate(letters, F.array(F.lit("")), more)


def motif_pattern(motif: str) -> str:
    """Regular expression of an IUPAC motif."""
    return "".join(c if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in motif.upper())


def reverse_motif(motif: str) -> str:
    """The IUPAC motif of the other strand."""
    return "".join(next(k for k, v in IUPAC.items() if set(v) == {"ACGT"["TGCA".index(b)] for b in IUPAC[c]}) for c in reversed(motif.upper()))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def is_dna(s: Column, length: int | None = None) -> Column:
    """Only A, C, G, T in either case, of the given length; false for null."""
    return F.coalesce(s.rlike("^[ACGTacgt]" + ("+$" if length is None else "{%d}$" % length)), F.lit(False))


def pseudo_dna(text: Column) -> Column:
    """A sequence made of the letters of a text, for tables without genomes."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])


def gc_percent(s: Column) -> Column:
    """Share of G and C in percent; null for an empty sequence."""
    return (F.length(s) - F.length(F.translate(s, "GCgc", ""))) * 100.0 / F.nullif(F.length(s), F.lit(0))


def has_run(s: Column, base: str, n: int) -> Column:
    return F.contains(s, F.lit(base * n))


def hits_site(s: Column, patterns: Sequence[str], flank5: str = "", flank3: str = "") -> Column:
    """Whether a restriction site, or its reverse complement, lies in the flanked sequence."""
    text = F.concat(F.lit(flank5), s, F.lit(flank3))
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(motif_pattern(p)) | reverse_complement(text).rlike(motif_pattern(p))
    return out


def keep_guide(s: Column, gc: tuple[float, float] = (0, 100), poly_t: bool = False, poly_g: bool = False, sites: Sequence[str] = (), flank5: str = "", flank3: str = "") -> Column:
    """Inclusion of a guide: GC percentage in a closed range, no TTTT, no GGGGG, no restriction site."""
    out = gc_percent(s).between(*gc)
    if poly_t:
        out = out & ~has_run(s, "T", 4)
    if poly_g:
        out = out & ~has_run(s, "G", 5)
    return out & ~hits_site(s, sites, flank5, flank3) if sites else out


def pack(s: Column) -> Column:
    """Two bits a base (A0 C1 G2 T3), the first base highest, up to 31 bases in a bigint."""
    return F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("bigint")


def unpack(v: Column, length: int) -> Column:
    return F.translate(F.lpad(F.conv(v.cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def packed_mismatches(a: Column, b: Column, mask: int = LOW_BITS) -> Column:
    """Different bases of two packed sequences of one length, at the places of ``mask`` (see :func:`compare_mask`)."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(mask)))


def compare_mask(guide: int, motif: int, five_prime: bool = False) -> int:
    """Low bits of the guide's bases in a packed site of guide and motif: what a comparison that leaves the motif out looks at."""
    bits = sum(1 << 2 * i for i in range(guide))
    return bits if five_prime else bits << 2 * motif


def prefix_mismatches(a: Column, b: Column, width: int, length: int, mask: int = LOW_BITS) -> Column:
    """Different bases among the first ``width`` of two packed sequences, at the places of ``mask``: the least distance of whole bins."""
    return packed_mismatches(F.shiftrightunsigned(a, 2 * (length - width)), F.shiftrightunsigned(b, 2 * (length - width)), mask >> 2 * (length - width))


def mismatches(a: Column, b: Column) -> Column:
    """Different characters over the shorter length, whatever the alphabet."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: (x != y).cast("int"))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(same, F.lit(0), lambda t, x: t + x))


def trimmed_mismatches(a: Column, b: Column, trim: int = 4, cap: int = 20) -> Column:
    """Mismatches after the first ``trim`` bases, over at most ``cap``; 999 where nothing is left to compare."""
    x, y = F.substring(a, trim + 1, cap), F.substring(b, trim + 1, cap)
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(999)).otherwise(mismatches(x, y))


def bin_key(s: Column, width: int) -> Column:
    return F.left(s, F.lit(width))


def context_31(context34: Column) -> Column:
    """The 31 bases that a 31-nt model takes of a 34-nt context."""
    return F.substring(context34, 2, 31)


def target_23(context: Column, protospacer: Column) -> Column:
    """Protospacer and PAM, 23 bases from where the protospacer lies in its context; null if it doesn't fit."""
    at = F.position(protospacer, context)
    out = F.substring(context, at, F.lit(23))
    return F.when((at > 0) & (F.length(out) == 23), out)


def pam_of_context(context: Column) -> Column:
    return F.substring(context, 5, 4)


def starts_tttt(s: Column) -> Column:
    return F.startswith(s, F.lit("TTTT"))


def starts_tttv(s: Column) -> Column:
    return s.rlike("^TTT[ACG]")


def one_hot(s: Column, order: str = "ACGT") -> Column:
    """One array of four numbers a base; all zero for other letters."""
    return F.transform(F.split(s, ""), lambda c: F.array(*((c == b).cast("int") for b in order)))


def tokens(s: Column, length: int = 21) -> Column:
    """Start token 1, then A2 T3 C4 G5 for the first ``length`` bases; null for other letters."""
    codes = F.transform(F.split(F.left(s, F.lit(length)), ""), lambda c: F.when(c.isin(*"ATCG"), F.instr(F.lit("ATCG"), c) + 1))
    return F.concat(F.array(F.lit(1)), codes)


def dinucleotides(s: Column) -> Column:
    """Overlapping pairs of bases; empty for fewer than two."""
    n = F.length(s)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(s, i, F.lit(2))))


def _table(values: Mapping[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def pair_sum(s: Column, values: Mapping[str, float], start: float = 0.0) -> Column:
    """``start`` plus a value for every overlapping pair; null if a pair has none."""
    table = _table(values)
    return F.aggregate(dinucleotides(s), F.lit(start), lambda t, p: t + F.element_at(table, p))


def binding_energy(s: Column) -> Column:
    """Free energy of an RNA-DNA hybrid."""
    return pair_sum(s, HYBRID, HYBRID_START)


def melting_temperature(s: Column, strand1: float = 25.0, strand2: float = 25.0, sodium: float = 50.0) -> Column:
    """Nearest-neighbour melting temperature in degrees Celsius (concentrations in nM, sodium in mM)."""
    ends = [F.when(x.isin("A", "T"), F.lit(1)).otherwise(F.lit(0)) for x in (F.left(s, F.lit(1)), F.right(s, F.lit(1)))]
    weak = ends[0] + ends[1]
    heat = pair_sum(s, {k: v[0] for k, v in NEAREST.items()}) + weak * 2.3 + (2 - weak) * 0.1
    order = pair_sum(s, {k: v[1] for k, v in NEAREST.items()}) + weak * 4.1 + (2 - weak) * -2.8
    order = order + F.lit(0.368) * (F.length(s) - 1) * F.log(F.lit(sodium * 1e-3))
    return F.lit(1000.0) * heat / (order + F.lit(1.987) * F.log(F.lit((strand1 - strand2 / 2) * 1e-9))) - F.lit(273.15)


def separate_pairs(s: Column, pair: str) -> Column:
    """Occurrences of a pair of bases that don't overlap."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(pair), F.lit("")))) / 2).cast("int")


def gc_features(s: Column) -> Column:
    """GC count of the first 20 bases, and whether it is above or below 10."""
    head = F.left(s, F.lit(20))
    n = F.length(head) - F.length(F.translate(head, "GC", ""))
    return F.struct(n.alias("gc"), (n > 10).cast("int").alias("above"), (n < 10).cast("int").alias("below"))


def five_prime_form(s: Column) -> Column:
    """Last 20 bases of the reversed (not complemented) sequence, for tools that expect the PAM at the 3' end."""
    return F.right(F.reverse(s), F.lit(20))


def replace_bases(s: Column, changes: Column) -> Column:
    """Sequence with single bases replaced; ``changes`` is an array of (pos from 1, base), later ones win."""
    return F.aggregate(changes, s, lambda t, c: F.overlay(t, c["base"], c["pos"], F.lit(1)))


def quantise(score: Column) -> Column:
    """A score of 0 to 1 in 16 bits."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 65535).cast("int")


def dequantise(q: Column) -> Column:
    return q / F.lit(65535.0)


def attribute(attributes: Column, key: str) -> Column:
    """Value of a GTF or GFF attribute, quoted or not; null where it is missing or empty."""
    return F.nullif(F.regexp_extract(attributes, f"(?:^|[;\\s]){key}[= ]\"?([^\";]*)\"?", 1), F.lit(""))


def block_aa_length(blocks: Column) -> Column:
    """Amino acids coded by blocks written ``start-end|start-end``, closed ranges, without the stop codon."""
    sizes = F.transform(F.split(blocks, r"\|"), lambda b: F.split(b, "-")[1].cast("long") - F.split(b, "-")[0].cast("long") + 1)
    return (F.aggregate(sizes, F.lit(0).cast("long"), lambda t, x: t + x) / 3).cast("long") - 1


def cell_targets(cell: Column) -> Column:
    """Off-targets of a cell ``SEQ_count_mm<chr:pos^S|...>,...``: array of (sequence, count, mm, loci)."""
    parts = F.filter(F.split(cell, r",(?![^<]*>)"), lambda x: F.trim(x) != "")
    pattern = "^([ACGTN]+)_(\\d+)_(\\d+)(?:<(.*)>)?"
    return F.transform(parts, lambda x: F.struct(
        F.regexp_extract(F.trim(x), pattern, 1).alias("sequence"), F.regexp_extract(F.trim(x), pattern, 2).try_cast("int").alias("count"), F.regexp_extract(F.trim(x), pattern, 3).try_cast("int").alias("mm"),
        F.filter(F.split(F.regexp_extract(F.trim(x), pattern, 4), r"\|"), lambda l: l != "").alias("loci"),
    ))


def numbers(cell: Column, separator: str = ",") -> Column:
    """The numbers of a delimited cell; pieces that are none give null."""
    return F.transform(F.split(cell, separator), lambda x: F.trim(x).try_cast("double"))


def rounded_list(cell: Column, digits: int) -> Column:
    """A delimited list with its numbers rounded half to even, other pieces as they are."""
    return F.array_join(F.transform(F.split(cell, ","), lambda x: F.coalesce(F.bround(F.trim(x).try_cast("double"), digits).cast("string"), F.trim(x))), ",")


def percent_and_raw(percent: Column, raw: Column) -> Column:
    """Text ``NN% (raw)`` with the percentile rounded half to even and four digits of the score; null if either is missing."""
    return F.concat(F.rint(percent).cast("int").cast("string"), F.lit("% ("), F.format_string("%.4f", raw), F.lit(")"))


def mismatch_counts(cell: Column) -> Column:
    """The first three of ``;``-separated counts, 0 where missing or no number."""
    parts = F.split(cell, ";")
    return F.array(*(F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3)))


# fixed values: colours of a guide in a genome track, worst class first
COLOURS = {"dropped": "150,150,150", "near": "120,120,120", "unspecific": "200,0,0", "low": "255,100,100", "middle": "255,255,0", "high": "0,200,0"}


def track_colour(dropped: Column, mm0: Column, mm1: Column, mm2: Column, specificity: Column, efficiency: Column) -> Column:
    """Colour of a guide: dropped or repeated, near off-targets, unspecific (at most 55), then efficiency below 50, below 75, above."""
    return (
        F.when(dropped | (mm0 > 0), COLOURS["dropped"]).when((mm1 > 0) | (mm2 > 0), COLOURS["near"]).when(F.coalesce(specificity, F.lit(0.0)) <= 55, COLOURS["unspecific"])
        .when(F.coalesce(efficiency, F.lit(0.0)) < 50, COLOURS["low"]).when(efficiency < 75, COLOURS["middle"]).otherwise(COLOURS["high"])
    )


def pair_key(key: str, complement: bool) -> tuple[str, str]:
    """Bases of a matrix key like ``rA:dC``: guide base and off-target base.

    U stands for T.  ``complement``: the key names the base opposite to the off-target's.
    """
    g, o = (x[-1].upper().replace("U", "T") for x in key.split(":"))
    return g, ("TGCA"["ACGT".index(o)] if complement else o)


def variant_key(name: str) -> str:
    """A variant's name without case, blanks, brackets and dashes."""
    return "".join(c for c in name.lower() if c.isalnum())
