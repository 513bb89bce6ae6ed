"""The chain from raw variants to candidates, against a plain walk over a small genome."""

from strandloom.operators import candidates

GENOME = {"c1": "ATGGCTGCAACGTTACCAGGCCTTCGAACCTGAAATTTGGGCCCATCGTTA" * 4, "c2": "ATGGCCGCTTAA" * 10}
CHUNK, WIDTH = 16, 20
CODE = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"))
FLIP = str.maketrans("ACGT", "TGCA")
PROBES = [("p1", "c1", 10), ("p2", "c1", 24), ("p3", "c1", 75), ("p4", "c1", 61), ("p5", "c1", 198), ("p6", "c1", 120), ("p7", "c1", 2)]
LINES = [
    ("t1", "c1", 1, 30, "+", "0", "protein_coding", "1 (x)", ["basic"]), ("t1", "c1", 41, 72, "+", "1", "protein_coding", "1 (x)", ["MANE_Select"]),
    ("t1", "c1", 41, 72, "+", "1", "protein_coding", "1 (x)", ["MANE_Select"]),  # once more
    ("t2", "c1", 4, 60, "-", "2", "protein_coding", None, ["basic"]), ("t2", "c1", 66, 130, "-", "0", "protein_coding", None, None),
    ("t3", "c1", 1, 90, "+", "0", "lncRNA", "1", ["MANE_Select"]), ("t4", "c1", 1, 90, "+", "0", "protein_coding", "1", ["cds_start_NF"]),
    ("t5", "c1", 1, 90, "+", "2", "protein_coding", "1", ["basic"]), ("t6", "c1", 190, 260, "+", "0", "protein_coding", "1", ["basic"]),
    ("t7", "c1", 3, 200, "+", ".", "protein_coding", "2", ["CCDS"]), ("t8", "c2", 1, 36, "+", "0", "protein_coding", "2", ["CCDS"]),
]


def transcripts():
    """{tx: [(place of each coding base, in order)]} of those that have a model."""
    out = {}
    for t in ("t1", "t2", "t7", "t8"):  # t3 to t6: kind, tag, phase, beyond the contig
        parts = sorted({(x[2], x[3], x[4]) for x in LINES if x[0] == t}, reverse=t == "t2")
        out[t] = [p for a, z, s in parts for p in (range(z, a - 1, -1) if s == "-" else range(a, z + 1))]
    return out


ORDER = {"t1": (0, 0), "t2": (1, 1), "t7": (2, 2), "t8": (2, 3)}


def walked(chrom, pos1, ref, alt):
    g = GENOME[chrom]
    if not 1 <= pos1 <= len(g) or g[pos1 - 1] != ref:
        return ("reference_mismatch",) + (None,) * 3
    found = []
    for t, places in transcripts().items():
        if next(x[1] for x in LINES if x[0] == t) == chrom and pos1 in places:
            i = places.index(pos1)
            turn = (lambda b: b.translate(FLIP)) if t == "t2" else (lambda b: b)
            codon = [turn(g[p - 1]) for p in places[i - i % 3 : i - i % 3 + 3]]
            changed = codon.copy()
            changed[i % 3] = turn(alt)
            if len(codon) == 3 and CODE["".join(codon)] == CODE["".join(changed)]:
                found.append((ORDER[t], t))
    if not found:
        return ("no_synonymous_transcript",) + (None,) * 3
    tx, v = min(found)[1], pos1 - 1
    near = sorted((abs(v - p), p, n) for n, c, p in PROBES if c == chrom)
    if not near:
        return "no_probe", tx, None, None
    _, p, name = near[0]
    off, mid = v - p, WIDTH // 2 - 1
    low = p - mid
    w = g[low : low + WIDTH] if low >= 0 else ""
    m = w[: mid + off] + alt + w[mid + off + 1 :]
    for reason, bad in (
        ("outside_window", abs(off) > mid), ("overlaps_cpg", off in (0, 1)), ("out_of_bounds", len(w) < WIDTH), ("not_cg_centred", w[mid : mid + 2] != "CG"),
        ("rc_not_cg_centred", m[::-1].translate(FLIP)[mid : mid + 2] != "CG"),
    ):
        if bad:
            return reason, tx, name, off
    return None, tx, name, off


def test_chain_equals_a_walk(spark):
    chunks = [(c, i // CHUNK, i, g[i : i + CHUNK].lower()) for c, g in GENOME.items() for i in range(0, len(g), CHUNK)]
    genome = spark.createDataFrame(chunks, "chrom string, chunk_id long, start long, seq string")
    lines = spark.createDataFrame(LINES, "tx string, chr string, start long, end long, strand string, phase string, kind string, support string, tags array<string>")
    probes = spark.createDataFrame(PROBES, "probe_id string, chr string, pos long")
    every = [(c, p, r, a) for c, g in GENOME.items() for p in range(1, len(g) + 3) for r in "ACGT" for a in "ACGT" if r != a]
    noise = [("c1", 5, "C", "C", 1), ("c1", 5, "N", "A", 1), (None, 5, "C", "A", 1), ("c1", None, "C", "A", 1), ("c1", 5, None, "A", 1)]
    raw = spark.createDataFrame([(*v, k % 3) for k, v in enumerate(every)] + [(*v, 7) for v in every[:200]] * 2 + noise, "chr string, pos1 long, ref string, alt string, case_id long")
    got = candidates.traced(candidates.unique_substitutions(raw), lines, genome, CHUNK, probes, WIDTH).collect()
    assert {(r.chr, r.pos1, r.ref, r.alt): (r.reason, r.tx, r.probe_id, r.offset) for r in got} == {v: walked(*v) for v in every}
    assert len(got) == len(every) and sum(r.n_cases for r in got) == len(every) + 200
    assert len({r.reason for r in got}) >= 7
    for r in got:
        if r.reason is None:
            assert r.wt[r["index"]] == r.ref and r.mut[r["index"]] == r.alt and len(r.mut) == WIDTH
            assert CODE[r.codon] == CODE[r.alt_codon] == r.amino and r.tx in r.transcripts and r.n_transcripts == len(r.transcripts)


def test_empty_tables_give_an_empty_one(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    raw = none("chr string, pos1 long, ref string, alt string, case_id long")
    lines = none("tx string, chr string, start long, end long, strand string, phase string, kind string, support string, tags array<string>")
    got = candidates.traced(candidates.unique_substitutions(raw), lines, none("chrom string, chunk_id long, start long, seq string"), CHUNK, none("probe_id string, chr string, pos long"), WIDTH)
    assert got.count() == 0 and {"reason", "wt", "mut", "tx", "offset"} <= set(got.columns)
