from strandloom.llm import quality


def test_junk_is_rejected_and_prose_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.quality(docs).collect() if not r.base_failed]
    junk = [r.kept for r in rows if r.n_symbols > r.n_words]
    good = [r.kept for r in rows if r.n_symbols <= r.n_words and labels.get(r.doc_id) == 1]
    assert len(junk) > 30 and sum(junk) <= 0.6 * len(junk)
    assert len(good) > 300 and sum(good) >= 0.95 * len(good)


def test_models_learn_from_what_passes_the_base_rules(spark):
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = spark.createDataFrame([("en", prose), ("en", "%&% " * 40), ("xx", "%&%")], "lang string, text string")
    counts = quality.count_trigrams(rows).toPandas()
    own = quality.trigrams("%&%").tolist()
    en = counts[(counts["lang"] == "en") & counts["code"].isin(own)]
    assert en["n"].sum() == 0 and en["failed"].sum() > 0
    assert len(quality.fit_language(counts[counts["lang"] == "xx"]).codes) == len(own)


def test_an_alphabet_is_a_language_s_own(spark):
    texts = {"ru": "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 9, "zh": "我能吞下玻璃而不伤身体。天地玄黄宇宙洪荒。" * 9, "el": "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία. " * 9}
    rows = spark.createDataFrame([*texts.items(), ("en", "")], "lang string, text string")
    own = quality.alphabets(rows)
    assert set(own) == set(texts)
    for lang, text in texts.items():
        letters = {c.lower() for c in text if c.isalpha()}
        assert len({int(own[lang].symbols(c)[2]) for c in letters}) == len(letters)  # none share a symbol
        assert own[lang].symbols("Ж")[2] == own[lang].symbols("ж")[2] < quality.EDGE
    many = quality.Alphabet(quality.np.arange(0x4E00, 0x9FA5))
    assert len(many.letters) == quality.LETTERS and 0 <= many.symbols("".join(map(chr, range(0x4E00, 0x9FA5)))).min()


def test_bands_and_verdicts_by_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("low", quality.F.lit("clash"))
    got = quality.quality(docs).collect()
    for lang in {r.lang for r in got}:
        own = [r for r in got if r.lang == lang]
        losses = sorted(round(r.loss, 4) for r in own if not r.base_failed and r.loss is not None)
        if losses:
            q1, q3 = quality.np.percentile(losses, [25, 75])
            low, high = q1 - max(4 * (q3 - q1), 0.02), q3 + max(2.5 * (q3 - q1), 0.02)
            assert all(abs(r.low - low) < 1e-9 and abs(r.high - high) < 1e-9 for r in own)
            assert all(r.kept == (not r.base_failed and (r.loss is None or low <= r.loss <= high)) for r in own)
