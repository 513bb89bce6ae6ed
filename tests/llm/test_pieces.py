import random
import time

import pytest

from strandloom.llm import pieces


def slow(p, text):
    """Viterbi over the whole text at once, by all pairs of positions."""
    best, n = [(0.0, [])], len(text)
    table = {raw.decode(): i for i, raw in enumerate(p.raw) if i not in p.byte_ids and i > 2}
    for j in range(1, n + 1):
        found = None
        for i in range(max(0, j - p.longest), j):
            s, ids = best[i]
            piece = table.get(text[i:j])
            options = [(s + p.scores[piece], [*ids, piece])] if piece is not None else []
            if j == i + 1 and text[i:j] not in table:
                options.append((s + p.unknown, [*ids, *(p.byte_ids[b] for b in text[i:j].encode())]))
            for o in options:
                if found is None or o[0] > found[0]:
                    found = o
        best.append(found)
    return best[-1][1]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load(pieces.model_file())


def test_equals_search_over_the_whole_text(vocabulary):
    rng = random.Random(5)
    parts = ["the", " ", "  ", "ing", "é", "\n", "\t", "▁", "日本", "\U0001f600", "a", "Zürich", "qqq", "0", "http://", "\x00"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert [x for part in vocabulary.stream([' ' + text]) for x in part] == vocabulary.encode(text) == slow(vocabulary, " " + text), text
        assert vocabulary.decode(vocabulary.encode(text)) == text


def test_chunks_don_t_matter_and_the_window_stays_short(vocabulary):
    rng = random.Random(6)
    text = " " + "".join(rng.choices("abcdefgh", k=600))
    whole = slow(vocabulary, text)
    for size in (1, 7, 500):
        parts = list(vocabulary.stream(text[k : k + size] for k in range(0, len(text), size)))
        assert [x for p in parts for x in p] == whole
        assert len(parts) > 5


@pytest.mark.parametrize("letters", ["ab", "a ", " ", "the ingé\n", "aé"])
def test_texts_whose_paths_meet_late_or_never(vocabulary, letters):
    rng = random.Random(7)
    for n in (1, 64, 70, 300, 1500):
        text = "".join(rng.choices(letters, k=n))
        want = slow(vocabulary, " " + text)
        assert vocabulary.encode(text) == want
        for size in (1, 64, 500):
            assert [x for part in vocabulary.stream((" " + text)[k : k + size] for k in range(0, n + 1, size)) for x in part] == want


@pytest.mark.parametrize("unit", [" ", "a", "eyJ", "\U0001f600"])
def test_a_million_of_one_character_take_seconds(vocabulary, unit):
    text = unit * (1_000_000 // len(unit))
    began = time.process_time()
    ids = vocabulary.encode(text)
    assert time.process_time() - began < 15  # a search that walks back over the open text takes hours
    assert vocabulary.decode(ids) == text


def test_a_run_of_spaces_beyond_a_chunk_is_searched_whole(vocabulary):
    text = "x" + " " * (pieces.CHUNK + 70) + "y z"
    assert vocabulary.encode(text) == [x for part in vocabulary.stream([" " + text]) for x in part]
    assert ["".join(vocabulary._chunks(t)) for t in (text, " " * 200_000, "a" * 200_000)] == [text, " " * 200_000, "a" * 200_000]


def test_edges(vocabulary):
    assert vocabulary.encode(None) == vocabulary.encode("") == [] and vocabulary.decode([]) == ""
    for text in (" ", "   ", "\n", "a" * 100_000, " x" * 50_000, "▁▁"):
        assert vocabulary.decode(vocabulary.encode(text)) == text


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Hello  world\n", 3), (1, "Hello  world\n", 3), (2, None, 4), (None, "x", 5)], "doc_id long, text string, ids int")
    rows = pieces.round_trip(docs).collect()
    assert len(rows) == 4 and all(r.round_trip for r in rows)
    assert {r.n_ids for r in rows if r.doc_id == 2} == {0}
    assert pieces.round_trip(docs.limit(0)).count() == 0


def test_ids_as_a_table_decode_to_the_texts(spark, sf_dir, vocabulary):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    source = {r.doc_id: r.text for r in docs.collect()}
    encoded = pieces.encode(docs, vocabulary)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {d: vocabulary.encode(t) for d, t in source.items()}
    back = pieces.decode(encoded, vocabulary).collect()
    assert {r.doc_id: r.text for r in back} == source and all(r.n_ids == len(vocabulary.encode(source[r.doc_id])) for r in back)
    hashes = {r.doc_id: (r.n_ids, r.decoded_chars, r.round_trip) for r in pieces.round_trip(docs, vocabulary).collect()}
    assert hashes == {d: (len(vocabulary.encode(t)), len(t), True) for d, t in source.items()}
