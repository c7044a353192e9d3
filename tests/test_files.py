"""Readers, writers and the pipeline from files to files."""

import gzip
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom import __main__ as cli
from seqloom import pipeline
from seqloom.functions import models
from seqloom.functions import sequence as sq
from seqloom.operators import annotation, motif, offtarget
from seqloom.sinks import writers
from seqloom.sources import readers
from seqloom.streaming import records


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    rng = random.Random(42)
    seqs = {n: "".join(rng.choice("ACGT") for _ in range(k)) for n, k in (("chrA", 1900), ("chrB", 700), ("chrC", 30))}
    seqs["chrA"] = seqs["chrA"][:500] + "NNNN" + seqs["chrA"][504:900] + seqs["chrA"][100:123] + seqs["chrA"][923:]
    folder = tmp_path_factory.mktemp("genome")
    text = "".join(f">{n} made up\n" + "\n".join(s[i : i + 60].lower() for i in range(0, len(s), 60)) + "\n" for n, s in seqs.items())
    with gzip.open(folder / "g.fa.gz", "wt") as f:
        f.write(text)
    return write(folder / "g.fa", text), str(folder / "g.fa.gz"), seqs


def test_fasta_as_rows_and_as_chunks(spark, genome, tmp_path):
    plain, packed, seqs = genome
    for path in (plain, packed):
        assert {r.contig: r.sequence for r in readers.fasta(spark, path).collect()} == seqs
    junk = write(tmp_path / "j.fa", "no header\nACGT\n>x y\nacg\nt\n>empty\n")
    assert {r.contig: r.sequence for r in readers.fasta(spark, junk).collect()} == {"x": "ACGT", "empty": ""}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for path, block in ((plain, None), (packed, None), (plain, "301"), (plain, "150")):  # one split, and many
            spark.conf.set("spark.sql.files.maxPartitionBytes", block or old[0])
            spark.conf.set("spark.sql.files.openCostInBytes", "1" if block else old[1])
            rows = readers.fasta_chunks(spark, path, 64, 10).collect()
            for n, s in seqs.items():
                own = sorted((r for r in rows if r.contig == n), key=lambda r: r.chunk_no)
                assert "".join(r.seq[r.chunk_start - r.seq_start :][: r.core] for r in own) == s
                assert all(r.seq == s[r.seq_start : r.chunk_start + r.core + 10] for r in own)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    got = {(r.contig, r.chunk_no, r.seq) for r in readers.fasta_chunks(spark, junk).collect()}
    assert got == {("x", 0, "ACGT"), ("empty", 0, "")}
    with pytest.raises(ValueError):
        readers.fasta_chunks(spark, plain, 10, 20)


def test_chunks_and_slices_agree_with_the_sequence(spark, genome):
    _, _, seqs = genome
    df = spark.createDataFrame(list(seqs.items()), "contig string, sequence string")
    chunks = motif.chunks(df, "contig", "sequence", 100, 25)
    regions = spark.createDataFrame([("chrA", 95, 305), ("chrB", 650, 900), ("chrX", 1, 5), ("chrA", 7, 7)], "chrom string, start long, end long")
    got = {r.name: r.sequence for r in readers.slices(chunks, regions).collect()}
    assert got == {"chrA_95:305": seqs["chrA"][95:305], "chrB_650:700": seqs["chrB"][650:700]}
    snps = spark.createDataFrame([("chrA", 100, "T"), ("chrA", 101, "G"), ("chrZ", 3, "A")], "chrom string, pos long, base string")
    changed = readers.with_snps(chunks, snps).where("contig = 'chrA' and chunk_no = 1").first()
    want = seqs["chrA"][:99] + "TG" + seqs["chrA"][101:]
    assert changed.seq == want[75:225]


def _sites(seq, pam_len, k, five, fits):
    out = []
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for i in range(len(seq) - k - pam_len + 1):
        w = seq[i : i + k + pam_len]
        for strand, s in (("+", w), ("-", rc(w))):
            pam, spacer = (s[:pam_len], s[pam_len:]) if five else (s[k:], s[:k])
            if set(s) <= set("ACGT") and fits(pam):
                out.append((i, strand, s))
    return sorted(out)


@pytest.mark.parametrize("enzyme,fits", [(motif.Enzyme("NGG", 20), lambda p: p[1:] == "GG"), (motif.Enzyme("TTTV", 23, True), lambda p: p[:3] == "TTT" and p[3] != "T"), (motif.Enzyme("NNGRRT", 21), lambda p: p[2] == "G" and p[3] in "AG" and p[4] in "AG" and p[5] == "T")])
def test_sites_against_brute_force(spark, genome, enzyme, fits):
    _, _, seqs = genome
    df = spark.createDataFrame(list(seqs.items()), "contig string, sequence string")
    got = motif.sites(df, "sequence", enzyme, ("contig",)).collect()
    for n, s in seqs.items():
        assert sorted((r.offset, r.strand, r.site) for r in got if r.contig == n) == _sites(s, len(enzyme.pam), enzyme.length, enzyme.five_prime, fits)
    pieces = readers.fasta_chunks(spark, genome[0], 97, 60)
    assert sorted(tuple(r) for r in motif.sites(pieces, "seq", enzyme, ("contig",), **motif.CHUNKED).collect()) == sorted(map(tuple, got))
    assert {(r.offset, r.strand) for r in motif.sites(df, "sequence", enzyme, ("contig",), pure=False).collect() if r.contig == "chrA"} >= {(r.offset, r.strand) for r in got if r.contig == "chrA"}
    guides = motif.guides(df, "contig", "sequence", enzyme).collect()
    assert sorted(map(tuple, motif.guides(pieces, "contig", "seq", enzyme, **motif.CHUNKED).collect())) == sorted(map(tuple, guides))
    for r in guides:
        s = seqs[r.contig][r.start : r.stop]
        rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert r.guide == (s if r.sense == "+" else rc) and r.guide in r.context
    inside = [x for n, s in seqs.items() for x in _sites(s, len(enzyme.pam), enzyme.length, enzyme.five_prime, fits)]
    assert 0.8 * len(inside) < len(guides) <= len(inside)


def test_near_matches_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(40)]
    mutated = ["".join(rng.choice("ACGT") if rng.random() < 0.12 else c for c in b) for b in base for _ in range(8)] + ["ACGTN" * 4, "AC", None]
    guides = spark.createDataFrame([(i, g) for i, g in enumerate(base)], "i int, guide string")
    sites = spark.createDataFrame([(j, s) for j, s in enumerate(mutated)], "j int, site string")
    for m in (0, 2, 4):
        both = [sorted((r.i, r.j, r.mm) for r in offtarget.near_matches(guides, sites, "guide", "site", 20, m, tabled).collect()) for tabled in (offtarget.TABLED, 5)]
        want = sorted((i, j, d) for i, g in enumerate(base) for j, s in enumerate(mutated) if s and len(s) == 20 and set(s) <= set("ACGT") and (d := sum(a != b for a, b in zip(g, s))) <= m)
        assert both == [want, want]
        again = offtarget.near_matches(guides.select("guide").unionAll(guides.select("guide").limit(1)), sites, "guide", "site", 20, m)
        assert again.count() == len(want) + sum(w[0] == 0 for w in want)


@pytest.mark.parametrize("most", (1, 3, 4))
def test_any_number_of_agreeing_segments_and_counts(spark, most):
    rng = random.Random(7)
    base = sorted({"".join(rng.choice("ACGT") for _ in range(20)) for _ in range(30)} | {"A" * 20})
    sites = ["".join(rng.choice("ACGT") if rng.random() < 0.15 else c for c in b) for b in base for _ in range(12)]
    distance = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = sorted((j, i, d) for j, s in enumerate(sites) for i, g in enumerate(base) if (d := distance(g, s)) <= most)
    for agree in (1, 2, 3, 4):
        table = offtarget._Table(base, 20, most, agree)
        assert sorted((int(j), int(i), int(d)) for block in table.near(table.pack(offtarget.pa.array(sites))) for j, i, d in zip(*block)) == want
    guides = spark.createDataFrame([(g,) for g in [*base, base[0], None, "ACG"]], "guide string")
    rows = spark.createDataFrame([(s.lower(), j % 3) for j, s in enumerate(sites)] + [(None, 1), ("N" * 20, 1)], "site string, n int").repartition(3)
    counts = {base[i]: [sum(j % 3 for j, k, d in want if k == i and d == x) for x in range(most + 1)] for _, i, _ in want}
    for tabled in (offtarget.TABLED, 4):
        got = {r[0]: list(r[1:]) for r in offtarget.near_counts(guides, rows, "guide", "site", "n", 20, most, tabled).collect()}
        assert {k: v for k, v in got.items() if any(v)} == {k: v for k, v in counts.items() if any(v)}
    assert offtarget.near_counts(guides.limit(0), rows, "guide", "site", "n", 20, most).count() == 0


def test_sites_of_odd_sequences(spark):
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "ACGT", "x"), (4, "é" + "acgt" * 5 + "aGG" + "中", "x")], "id int, s string, offset string")
    got = motif.sites(odd, "s", motif.PRESETS["spcas9-ngg"], ("id",), around=(1, 3)).collect()
    assert [tuple(r) for r in got] == [(4, 1, "+", "ACGT" * 5 + "AGG", "?" + "ACGT" * 5 + "AGG")]
    assert motif.sites(odd.limit(0), "s", motif.PRESETS["spcas9-ngg"]).count() == 0
    whole = motif.chunks(odd, "id", "s", 5, 2).orderBy("contig", "chunk_no").collect()
    assert [(r.contig, r.chunk_no, r.chunk_start, r.core, r.seq_start, r.seq) for r in whole][:2] == [(3, 0, 0, 4, 0, "ACGT"), (4, 0, 0, 5, 0, "éacgtac")]


GTF = """#!comment
chr1\tx\tgene\t1\t900\t.\t+\t.\tgene_id "g1"; gene_name "A B";
chr1\tx\texon\t101\t200\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
chr1\tx\texon\t301\t400\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
chr1\tx\tCDS\t151\t350\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
chr1\tx\texon\t111\t220\t.\t+\t.\tgene_id "g1"; transcript_id "t2";
chr1\tx\tCDS\t151\t190\t.\t+\t.\tgene_id "g1"; transcript_id "t2";
chr2\tx\texon\t50\t80\t.\t-\t.\tgene_id "g2"; transcript_id "t3";
"""


def test_annotation_files(spark, tmp_path):
    path = write(tmp_path / "a.gtf", GTF)
    rows = readers.gtf(spark, path)
    assert readers.annotation_format(spark, path) == "gtf" and rows.count() == 7 and rows.first().pairs == {"gene_id": "g1", "gene_name": "A B"}
    rows = rows.where("transcript_id is not null").drop("pairs")
    got = lambda df: sorted((r.gene_id, r.feature, r.start, r.end) for r in df.collect())
    assert got(annotation.consensus(rows)) == [("g1", "CDS", 151, 190), ("g1", "exon", 111, 200), ("g2", "exon", 50, 80)]
    assert got(annotation.metagene(rows)) == [("g1", "CDS", 151, 350), ("g1", "exon", 101, 220), ("g1", "exon", 301, 400), ("g2", "exon", 50, 80)]
    assert got(annotation.untranslated(rows)) == [("g1", "UTR3", 191, 220), ("g1", "UTR3", 351, 400), ("g1", "UTR5", 101, 150), ("g1", "UTR5", 111, 150)]
    assert {r.transcript_id for r in annotation.by_coding_length(rows).collect()} == {"t1"} and {r.transcript_id for r in annotation.by_coding_length(rows, False).collect()} == {"t2"}
    tss = {r.transcript_id: (r.start, r.end) for r in annotation.end_windows(rows, 30, 5).collect()}
    assert tss == {"t1": (70, 106), "t2": (80, 116), "t3": (74, 110)}
    half = sorted((r.transcript_id, r.start, r.end) for r in annotation.truncate(rows, "exon", 0, 50).collect())
    assert half == [("t1", 101, 200), ("t2", 111, 166), ("t3", 64, 80)]
    writers.gtf(annotation.metagene(rows), str(tmp_path / "out"), "metagene", True)
    assert readers.gtf(spark, str(tmp_path / "out")).count() == 4
    gff = write(tmp_path / "a.gff", "chr1\tx\texon\t5\t9\t.\t+\t.\tParent=t1\nchr1\tx\tmRNA\t1\t9\t.\t+\t.\tID=t1;Parent=g1\nchr1\tx\tgene\t1\t9\t.\t+\t.\tID=g1\n")
    assert readers.annotation_format(spark, gff) == "gff"
    assert sorted((r.feature, r.gene_id, r.transcript_id) for r in readers.gff(spark, gff).collect()) == [("exon", "g1", "t1"), ("gene", "g1", None), ("transcript", "g1", "t1")]


def test_tables_of_other_tools(spark, tmp_path):
    salmon = [write(tmp_path / f"s{i}.sf", "Name\tLength\tEffectiveLength\tTPM\tNumReads\n" + "".join(f"t{j}\t9\t9\t{j * i}.5\t1\n" for j in range(i, 4))) for i in (1, 2)]
    assert readers.quantifier(spark, salmon[0]) == "salmon"
    q = readers.quantification(spark, salmon)
    assert sorted(r.transcript_id for r in q.collect()) == ["t1", "t2", "t3"] and len(q.columns) == 3
    flair = write(tmp_path / "f.tsv", "ids\ta\tb\nr;1_g1\t4\t5\n")
    assert tuple(readers.quantification(spark, [flair]).first()) == ("r:1", 4.0, 5.0)
    mandalorian = write(tmp_path / "m.tpm", "Isoform\ta\t\nI1\t2.5\t\n")
    assert tuple(readers.quantification(spark, [mandalorian]).first()) == ("I1", 2.5)
    with pytest.raises(ValueError):
        readers.quantifier(spark, write(tmp_path / "x.tsv", "what\n"))
    bed = write(tmp_path / "r.bed", "chr1\t5\t9\nchr1\t7\t12\n")
    assert [r.name for r in readers.bed(spark, bed).orderBy("start").collect()] == ["chr1_5_9", "chr1_7_12"]
    with pytest.raises(ValueError):
        readers.bed(spark, write(tmp_path / "bad.bed", "chr1\t9\t5\tx\n"))
    kmers = write(tmp_path / "k.csv", "id,sequence,pam,chromosome,position,sense\na,ACGTA,NGG,c,5,+\n")
    assert readers.kmers(spark, kmers, 5, 3).first().pam == "AGG"
    with pytest.raises(Exception):
        readers.kmers(spark, kmers, 6, 3).collect()
    matrix = write(tmp_path / "m.csv", "RDA,Pos,MM,avg_percent_active\nx,1,rA:dC,0.25\nx,2,rU:dG,0.5\n")
    assert readers.penalty_matrix(spark, matrix) == {(1, "A", "C"): 0.25, (2, "T", "G"): 0.5}
    assert readers.penalty_matrix(spark, matrix, True) == {(1, "A", "G"): 0.25, (2, "T", "C"): 0.5}
    ff = write(tmp_path / "ff.tsv", "contig\tstart\tstop\ttarget\tcontext\toverflow\torientation\totCount\toffTargets\nc\t0\t24\tA\tN\tOK\tFWD\t1\tA_1_0<c:1^F>\nc\t1\t25\tA\tN\tOK\tRVS\t1\tx\n")
    assert readers.flashfry(spark, ff).count() == 1
    assert readers.snps(spark, [write(tmp_path / "1.tsv", "c\t5\ta\n"), write(tmp_path / "2.tsv", "c\t5\tg\nc\t6\tt\n")]).orderBy("pos").collect()[0].base == "G"
    assert readers.signal(spark, write(tmp_path / "s.bg", "c\t0\t5\t1.5\n")).first().value == 1.5


def test_models_by_layers(spark, tmp_path):
    rng = np.random.default_rng(0)
    r = lambda *s: rng.normal(size=s) * 0.1
    w = {"conv_kernel": r(5, 4, 80), "conv_bias": r(80), "dense1_kernel": r(1200, 80), "dense1_bias": r(80), "dense2_kernel": r(80, 40), "dense2_bias": r(40), "dense3_kernel": r(40, 40), "dense3_bias": r(40), "out_kernel": r(40, 1), "out_bias": r(1)}
    np.savez(tmp_path / "w.npz", **w)
    seqs = ["".join(random.Random(i).choice("ACGT") for _ in range(34)) for i in range(5)]
    df = spark.createDataFrame([(s,) for s in [*seqs, "ACGT", None, "N" * 34]], "s string")
    got = [x.v for x in df.select(models.score(F.col("s"), "cas12a_cnn", str(tmp_path / "w.npz")).alias("v")).collect()]
    x = models.one_hot(seqs)
    conv = np.array([[[(x[n, i : i + 5] * w["conv_kernel"][:, :, o]).sum() + w["conv_bias"][o] for o in range(80)] for i in range(30)] for n in range(5)])
    h = np.maximum(conv, 0).reshape(5, 15, 2, 80).mean(2).reshape(5, -1)
    for k in ("dense1", "dense2", "dense3"):
        h = np.maximum(h @ w[f"{k}_kernel"] + w[f"{k}_bias"], 0)
    assert np.allclose(got[:5], (h @ w["out_kernel"] + w["out_bias"])[:, 0], atol=1e-5) and got[5:] == [None] * 3
    features = models.composition_features(seqs)
    assert features.shape == (5, 689) and features[0, 0] == pytest.approx(sum(c in "CG" for c in seqs[0]) / 34)
    tm = spark.createDataFrame([(s,) for s in seqs], "s string").select(sq.melting_temperature(F.col("s")).alias("t")).collect()
    assert np.allclose([x.t for x in tm], models.melting(seqs))
    trees = {"feature": np.array([[0, -1, -1]]), "threshold": np.array([[0.5, 0, 0]]), "left": np.array([[1, 0, 0]]), "right": np.array([[2, 0, 0]]), "value": np.array([[0, -1.0, 2.0]]), "depth": 2, "start": 0.5, "rate": 0.1}
    assert np.allclose(models.boosted_trees(np.array([[0.2], [0.9]]), trees), [0.4, 0.7])
    assert models.lstm(r(2, 6, 3), r(3, 16), r(4, 16), r(16)).shape == (2, 6, 4)
    deep = {"conv1_kernel": r(5, 4, 8), "conv1_bias": r(8), "conv2_kernel": r(5, 8, 8), "conv2_bias": r(8), "dense1_kernel": r(248, 6), "dense1_bias": r(6), "dense2_kernel": r(6, 6), "dense2_bias": r(6), "out_kernel": r(6, 1), "out_bias": r(1)}
    assert ((p := models.cas12a_deep_cnn([s[:31] for s in seqs], deep)) > 0).all() and (p < 1).all()
    assert models.chosen(["both", "cas12a_cnn"], True, None, {}) == ["cas12a_cnn", "composition_trees"]
    with pytest.raises(ValueError):
        models.chosen(["cas12a_cnn"], True, "Chen2013", {})


def test_pipeline_from_files_to_files(spark, genome, tmp_path):
    plain, _, seqs = genome
    keep = write(tmp_path / "keep.bed", "chrA\t50\t800\tk\nchrB\t0\t400\tk2\n")
    drop = write(tmp_path / "drop.bed", "chrA\t200\t260\td\n")
    cli.main(["generate-guides", plain, "-o", str(tmp_path / "g"), "--keep", keep, "--discard", drop, "--gc", "20", "80", "--no-poly-t"])
    guides = spark.read.parquet(str(tmp_path / "g/guides"))
    rows = guides.collect()
    assert rows and all("TTTT" not in r.guide and 20 <= sum(c in "GC" for c in r.guide) * 5 <= 80 for r in rows)
    for r in rows:
        assert (50 < r.cut_start + 1 and r.cut_start - 1 < 800 and not (200 < r.cut_start + 1 and r.cut_start - 1 < 260)) if r.contig == "chrA" else r.cut_start - 1 < 400
    cli.main(["index-genome", plain, "-o", str(tmp_path / "i")])
    sites = readers.index(spark, str(tmp_path / "i"))
    factor = lambda p, g, o: round(0.1 + 0.02 * p + 0.05 * "ACGT".index(g) + 0.03 * "ACGT".index(o), 4)
    matrix = write(tmp_path / "matrix.csv", "Pos,MM,avg_percent_active\n" + "".join(f"{p},r{g.replace('T', 'U')}:d{o},{factor(p, g, o)}\n" for p in range(1, 21) for g in "ACGT" for o in "ACGT" if g != o))
    cli.main(["score-guides", str(tmp_path / "g/guides"), "--index", str(tmp_path / "i"), "-o", str(tmp_path / "s"), "--keep-duplicates", "--matrix", matrix])
    scored = spark.read.parquet(str(tmp_path / "s")).collect()
    places = Counter()
    for s in sites.collect():
        places[s.site] += s.loci
    all_sites = list(places.items())
    with pytest.raises(ValueError):
        pipeline.score_guides(guides, sites)
    near = {g.guide for g in rows if any((d := sum(a != b for a, b in zip(g.guide, s))) <= 2 and (d > 0 or n > 1) for s, n in all_sites)}
    assert {r.guide for r in scored} == {r.guide for r in rows} - near and all(0 < r.specificity_index <= 1 for r in scored)
    # the whole score, with the weight of the motif, of guides against sites that were changed in one to four places
    tails = list(sq.PAM_TAIL) + ["TT"]
    changed = [(("T" if g.guide[0] != "T" else "A") + g.guide[1 : 10 + k] + "".join("ACGT"["ACGT".index(c) - 1] for c in g.guide[10 + k : 10 + 2 * k]) + g.guide[10 + 2 * k :], "A" + tails[(i + k) % 8], 1 + k) for i, g in enumerate(rows[:20]) for k in range(4)]
    table = spark.createDataFrame(changed, "site string, pam string, loci long")
    hits = pipeline.near_hits(spark.createDataFrame(rows[:20]), table, readers.penalty_matrix(spark, matrix), 20, 4).collect()
    assert {h.mm for h in hits} == {1, 2, 3, 4}
    for h in hits:
        product = math.prod(factor(p, a, b) for p, (a, b) in enumerate(zip(h["__guide"], h.site), 1) if a != b)
        assert h.cfd == pytest.approx(product * sq.PAM_TAIL.get(h.pam[1:], 0.0))
    cli.main(["rank-guides", str(tmp_path / "s"), keep, "-o", str(tmp_path / "r"), "--columns", "specificity_index", "-n", "3", "--spacing", "5"])
    ranked = spark.read.parquet(str(tmp_path / "r")).collect()
    targets = {"k", "k2"}
    assert {r.value for r in spark.read.text(str(tmp_path / "r.without")).collect()} == targets - {r.target_id for r in ranked}
    counts = {r.target_id: int(r["rows"]) for r in spark.read.csv(str(tmp_path / "r.counts"), sep="\t", header=True).collect()}
    assert counts == {t: sum(r.target_id == t for r in ranked) for t in targets}
    # every place of every hit, in both forms, and the sidecar
    cli.main(["score-guides", str(tmp_path / "g/guides"), "--index", str(tmp_path / "i"), "-o", str(tmp_path / "h"), "--keep-duplicates", "--matrix", matrix, "--threshold", "-1", "--mismatches", "2", "--hits", "both", "--name", "all"])
    hits = spark.read.csv(str(tmp_path / "h.hits"), header=True).collect()
    at = [(p.site, p.contig, p.offset, p.strand) for p in spark.read.parquet(str(tmp_path / "i/places")).collect()]
    near = lambda g, s: sum(a != b for a, b in zip(g, s))
    want = sorted((r.guide, c, str(o), st, str(near(r.guide, s))) for r in rows for s, c, o, st in at if near(r.guide, s) <= 2)
    assert sorted((h.sequence, h.match_chrm, h.match_position, h.match_strand, h.match_distance) for h in hits) == want
    lists = {(r.contig, int(r.start), r.strand): r.offTargets for r in spark.read.csv(str(tmp_path / "h.hits.detail"), sep="\t", header=True).collect()}
    assert lists.keys() == {(r.contig, r.start, r.sense) for r in rows}
    assert sum(int(x.split("_")[1]) for v in lists.values() for x in v.split(",")) == len(want)
    side = spark.read.csv(str(tmp_path / "h.sidecar"), sep="\t", header=True).collect()
    assert sorted(int(r.guide_id) for r in side) == list(range(len(rows))) and {r.sequence for r in side} == {r.guide for r in rows}
    # the track: each guide's line begins where its row says
    spark.read.parquet(str(tmp_path / "g/guides")).withColumn("eff", F.rand(1)).write.parquet(str(tmp_path / "e"))
    cli.main(["track", str(tmp_path / "e"), "--index", str(tmp_path / "i"), "-o", str(tmp_path / "t"), "--matrix", matrix, "--mismatches", "4", "--efficiency", "eff"])
    (part,) = (tmp_path / "t/details").glob("part-*")
    data = part.read_bytes()
    bed = spark.read.csv(str(tmp_path / "t/bed"), sep="\t").collect()
    assert len(bed) == len(rows) and "offset" in "".join(r.value for r in spark.read.text(str(tmp_path / "t/columns")).collect())
    for r in bed:
        guide, offset = r[3].split(",")[1], int(r[-1])
        off = [(s, c, o, st) for s, c, o, st in at if 0 < near(guide, s) <= 4]
        assert bool(off) == (offset > 0)
        if off:
            counts, listed = data[offset:].split(b"\n", 1)[0].decode().split("\t")
            assert counts.split(";")[1:] == [str(sum(near(guide, x[0]) == d for x in off)) for d in range(1, 5)]
            assert sorted(x.rsplit(";", 1)[0] for x in listed.split("|")) == sorted(f"{c}:{o};{st}" for _, c, o, st in off)
    assert {r.target_id for r in ranked} <= {"chrA_50_800", "k", "k2"} and max(r.rank_no for r in ranked) <= 3
    assert pipeline.preprocess_annotation(readers.gtf(spark, write(tmp_path / "a.gtf", GTF)).where("transcript_id is not null").drop("pairs"), model="metagene")["model"].count() == 4


def test_writers(spark, tmp_path, genome):
    df = spark.createDataFrame([("a", 1.5, None), ("b", None, 2.0)], "id string, rs3 double, specificity_x double")
    writers.scored_bed(df, str(tmp_path / "s"), ["id", "rs3"], True)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "s")).collect()) == ["a\t1.5\t-1", "b\t-1\t2.0", "id\trs3\tspecificity_x"]
    assert writers.output_path("out", "/x/genome.fa.gz", "guides") == "out/genome_guides/genome_guides"
    totals = spark.createDataFrame([("a", 0.5, 0.1, 3, [0, 1, 2], True)], "id string, specificity double, max_cfd double, off_count long, mm_counts array<int>, saturated boolean")
    writers.aggregate_csv(totals, str(tmp_path / "a"), spark.createDataFrame([("z",)], "id string"))
    back = {r.id: r for r in spark.read.csv(str(tmp_path / "a"), header=True).collect()}
    two = totals.withColumnsRenamed({"specificity": "specificity_tttn"}).withColumn("specificity_tttv", F.lit(0.7))
    writers.aggregate_csv(two, str(tmp_path / "a12"), kind="cas12a")
    assert spark.read.csv(str(tmp_path / "a12"), header=True).columns[:3] == ["id", "specificity_tttn", "specificity_tttv"]
    assert back["a"].mismatch_counts == "0;1;2" and back["z"].specificity is None and back["z"].dropped == "1"
    hits = spark.createDataFrame([("c", 5, "+", "ACG", "ACT", 1, 2), ("c", 5, "+", "ACG", "ACG", 0, 1)], "contig string, start long, strand string, guide string, site string, mm int, loci long")
    writers.off_target_tsv(hits, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first().offTargets == "ACG_1_0,ACT_2_1"
    writers.slim(df, str(tmp_path / "slim"), ["id", "nothing"])
    assert spark.read.csv(str(tmp_path / "slim"), header=True).columns == ["id"]
    _, _, seqs = genome
    guides = motif.guides(spark.createDataFrame(list(seqs.items()), "contig string, sequence string"), "contig", "sequence", motif.PRESETS["spcas9-ngg"])
    writers.guide_bed(guides, str(tmp_path / "bed"), True)
    writers.guide_fasta(guides, str(tmp_path / "fa"))
    assert spark.read.csv(str(tmp_path / "bed"), sep="\t", header=True).columns[3] == "id,sequence,pam,chromosome,position,sense"


def test_stream_of_records_equals_the_batch(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/ot_records.parquet")
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    query = records.write_totals(records.read(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    got = {r.guide_id: (r["rows"], round(r.cfd_sum, 6)) for r in records.current(spark, str(tmp_path / "out")).collect()}
    once = batch.where("guide_id is not null").dropDuplicates(records.KEYS)
    assert got == {r.guide_id: (r["rows"], round(r.s, 6)) for r in once.groupBy("guide_id").agg(F.count("*").alias("rows"), F.sum("cfd").alias("s")).collect()}
