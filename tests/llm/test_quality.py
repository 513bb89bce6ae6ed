import math
from collections import Counter

import numpy as np

from strandloom.llm import quality


def test_probabilities_sum_to_one_and_search_equals_table():
    rng = np.random.default_rng(1)
    codes = quality.trigrams("the cat sat on the mat " * 20 + "".join(map(chr, rng.integers(97, 123, 500))))
    u, n = np.unique(codes, return_counts=True)
    m = quality.KneserNey.fit(u, n)
    table = m.table().reshape(-1, quality.SYMBOLS)
    assert np.allclose((10.0**table).sum(axis=1), 1, atol=1e-3)
    assert np.allclose(m.log10(codes), m.table()[codes], atol=1e-6)


def test_small_model_against_plain_formula():
    text = "abab abc abb"
    counts = Counter(quality.trigrams(text).tolist())
    m = quality.KneserNey.fit(np.array(list(counts)), np.array(list(counts.values())))
    d = [0, 0.5, 0.75, 0.9]  # no counts of four, so fixed discounts
    split = lambda c: (c >> 14, c >> 7 & 127, c & 127)
    tri = {split(c): n for c, n in counts.items()}
    left = Counter((b, c) for _, b, c in tri)
    first = Counter(c for _, c in left)

    def level(n, total, kinds, lower):
        return (n - d[min(n, 3)]) / total + sum(d[min(k, 3)] for k in kinds) / total * lower

    def p1(c):
        return level(first[c], sum(first.values()), first.values(), 1 / 128)

    def p2(b, c):
        row = [n for (x, _), n in left.items() if x == b]
        return level(left[b, c], sum(row), row, p1(c)) if row else p1(c)

    for a, b, c in [*tri, (127, 127, 127), (tri and next(iter(tri))[0], 5, 6)]:
        row = [n for (x, y, _), n in tri.items() if (x, y) == (a, b)]
        want = level(tri.get((a, b, c), 0), sum(row), row, p2(b, c)) if row else p2(b, c)
        assert math.isclose(float(m.log10(np.array([a << 14 | b << 7 | c]))[0]), math.log10(want), abs_tol=1e-5)


def test_features():
    assert quality.features("") == (0, 0, 0, 0, 0)
    assert quality.features("a b\n\na b\n \né#$ a b") == (7, 9, 2, 1, 0)
    w = "x y z q x y z".encode().split()
    assert quality.repeated_words(w) == 6
    assert quality.repeated_words(b"a a a a".split()) == 4


def test_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None), (-2, "word " * 40000, "en"), (-2, "x", "zz"), (None, "#$% " * 80, "en")], "doc_id long, text string, lang string")
    rows = docs.unionByName(extra, allowMissingColumns=True)
    got = quality.quality(rows).collect()
    assert len(got) == rows.count()
    prose = [r for r in got if not r.base_failed and (r.doc_id or -1) >= 0]
    assert sum(r.kept for r in prose) > 0.95 * len(prose)
    assert not any(r.kept for r in got if r.doc_id == -2)
    many = {(str(r.doc_id), r.kept) for r in quality.quality(rows, langs_at_once=2).collect()}
    assert many == {(str(r.doc_id), r.kept) for r in got}
    assert quality.quality(docs.limit(0)).count() == 0


def _texts():
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 7)))) for _ in range(60)]
    return [" ".join(rng.choice(words, 70)) for _ in range(12)] + ["a  B\n c", "", "%&% " * 30, "ab " * 70]


def test_tables_give_the_losses_of_the_arrays(spark):
    rows = spark.createDataFrame([(i % 5 or None, "en", t) for i, t in enumerate(_texts())], "doc_id long, lang string, text string")
    own = quality.alphabets(rows)
    models = {"en": quality.fit_language(quality.count_trigrams(rows, own).toPandas())}
    key = lambda r: (r.doc_id or 0, *r[2:8])
    want = sorted(quality.score(rows, models, own).collect(), key=key)
    got = sorted(quality.wide_letters.score(rows, spark.createDataFrame([("en", quality.SYMBOLS)], "lang string, v long")).collect(), key=key)
    assert len(got) == len(want) and sum(r.loss is None for r in want) == 1
    for g, w in zip(got, want):
        assert key(g) == key(w) and (g.loss is None) == (w.loss is None) and (w.loss is None or abs(g.loss - w.loss) < 1e-5)


def test_no_characters_of_a_large_language_share_a_symbol(spark):
    """Texts that differ in characters beyond an alphabet of 112 have losses of their own."""
    rng = np.random.default_rng(4)
    signs = [chr(0x4E00 + i) for i in range(400)]
    prose = [" ".join("".join(rng.choice(signs, 3)) for _ in range(80)) for _ in range(20)]
    own = quality.alphabets(spark.createDataFrame([("zh", x) for x in prose], "lang string, text string"))["zh"]
    by_symbol = {}
    for s in signs:
        by_symbol.setdefault(int(own.symbols(s)[2]), []).append(s)
    shared = next(v for v in by_symbol.values() if len(v) > 2)
    texts = [*prose, *[prose[0].replace(prose[0][0], x) for x in shared[:3]]]
    assert (quality.trigrams(texts[20], own) == quality.trigrams(texts[21], own)).all()
    rows = spark.createDataFrame([(i, lang, t) for lang in ("zh", "yue") for i, t in enumerate(texts)] + [(7, "en", _texts()[0]), (8, "xx", None)], "doc_id long, lang string, text string")
    got = quality.quality(rows).collect()
    assert len(got) == 2 * len(texts) + 2
    of = {(r.lang, r.doc_id): r for r in got}
    assert len({of["zh", i].loss for i in (20, 21, 22)}) > 1 and of["zh", 3].loss == of["yue", 3].loss and of["xx", 8].loss is None
    assert all(r.low is not None for r in got if r.lang == "zh")
    counts = quality.wide_letters.count_trigrams(rows.filter("lang = 'zh'"))
    assert {c for (x,) in counts.select("code").collect() for c in (x >> 42, x >> 21 & 2**21 - 1, x & 2**21 - 1)} == {quality.wide_letters.EDGE, 32, *(ord(s) for s in set("".join(texts)) if s != " ")}
