import re
import zlib
from collections import Counter

import pytest

from strandloom.llm import spelling

UP = {a: a + 32 for a in range(65, 91)}


def plain(rows):
    """The contract's rows by comparing all pairs of words."""
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1 :]), set()).add(w)  # equal but for the place i
    near = {w: set() for w in words}
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            if (s := w[:i] + w[i + 1 :]) in words:
                near[w].add(s), near[s].add(w)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), k, len(near[w]), words[form[w]] if w in form else None) for w, k in words.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(spelling.variants(docs)) == want and sum(w[4] for w in want) > 100


def test_every_kind_of_edit_and_chains(spark):
    words = ["station", "statin", "statioon", "xstation", "tation", "stations", "stadion", "Station", "stätion", "stationx", "sstation", "anagana", "anaganana", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaaa"]
    rows = [(i, " ".join(words) + " " + w + "-" + w) for i, w in enumerate(words)] + [(100 + i, "station " * 400 + "stations " * 6 + "aaaaaaaa1" * 70) for i in range(3)]
    rows += [(None, None), (None, "STATION"), (7, ""), (8, "ÀÉÎõüñç ÀÉÎõüñç Àéîõüñç ÀÉÎõüñ ÀÉÎõüñ"), (9, "stationsx stationsx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as word", "doc_id as n")
    want = plain(rows)
    assert rows_of(spelling.variants(docs)) == want
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want if w[1])


def test_long_words_and_runs(spark):
    base = "".join(chr(97 + i * i % 23) for i in range(3000))
    words = [base, base[:1500] + base[1501:], base[:10] + "q" + base[11:], base + "zz", base[:2990], "b" * 5000, "b" * 4999, "b" * 4997]
    rows = [(i, " ".join(words)) for i in range(3)]
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


@pytest.mark.parametrize("texts", [[], [None], ["short words only"]])
def test_no_words(spark, texts):
    assert rows_of(spelling.variants(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))) == []
