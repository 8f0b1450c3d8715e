"""Readers, writers and the file-to-file jobs through temporary directories."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chronotext.operators import blocks, topic_model
from chronotext.plans import jobs
from chronotext.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def get(path):
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    return "".join(p.read_text(encoding="utf-8") for p in parts).splitlines()


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é a",), ('q"\\',)], "value string")
    writers.write_lines(df, str(tmp_path / "out"))
    writers.write_lines(df, str(tmp_path / "out"))
    assert sorted(get(tmp_path / "out")) == sorted(["é a", 'q"\\'])
    with pytest.raises(AnalysisException):
        writers.write_lines(df, str(tmp_path / "out"), overwrite=False)


def test_identified_lines_are_unique(spark, tmp_path):
    path = put(tmp_path / "in.txt", "a\na\nb\n")
    got = readers.read_identified_lines(spark, path).collect()
    assert sorted(r.value for r in got) == ["a", "a", "b"] and len({r.line_id for r in got}) == 3


def test_table_takes_quotes_literally(spark, tmp_path):
    path = put(tmp_path / "t.tsv", '1800\tsay "x\\ty"\nxxxx\t"open\n')
    got = sorted(tuple(r) for r in readers.read_table(spark, path, "year", "text").collect())
    assert got == [("1800", 'say "x\\ty"'), ("xxxx", '"open')]


def test_year_texts(spark, tmp_path):
    path = put(tmp_path / "in.tsv", "1900\tthe cat\tmore\n1903\t\nonly\n")
    got = readers.read_year_texts(spark, path).select("year", "text").collect()
    assert [tuple(r) for r in got] == [("1900", "the cat")]


def test_page_dump(spark, tmp_path):
    path = put(
        tmp_path / "dump.xml",
        "<mediawiki><page><title>A &amp; b</title><id>12</id><revision><id>1</id><text>x\n\ty</text></revision></page>"
        "<page><title>C</title><id>13</id><revision><text>z</text></revision></page></mediawiki>",
    )
    got = sorted(tuple(r) for r in readers.read_page_dump(spark, path).collect())
    assert [(i, t) for i, t, _ in got] == [(12, "A & b"), (13, "C")]
    assert got[0][2].split() == ["x", "y"]


def test_listed_texts(spark, tmp_path):
    listing = put(tmp_path / "list.txt", "one\t1805-01-01\ntwo\t1806\nlost\t1807\n")
    put(tmp_path / "texts" / "one_clean.txt", "a\nb\r\nc\n")
    put(tmp_path / "texts" / "two_clean.txt", "x")
    put(tmp_path / "texts" / "other.txt", "y")
    found, lost = readers.read_listed_texts(spark, listing, str(tmp_path / "texts"))
    assert sorted(tuple(r) for r in found.collect()) == [("one", 1805, "a b c"), ("two", 1806, "x")]
    assert [tuple(r) for r in lost.collect()] == [("lost", 1807)]


def test_listed_texts_with_any_title(spark, tmp_path):
    titles = ["A Tale", "a%20b", "x+y", "Émile"]
    listing = put(tmp_path / "list.txt", "".join(f"{t}\t1805\n" for t in titles))
    for title in titles:
        put(tmp_path / "texts" / f"{title}_clean.txt", title)
    found, lost = readers.read_listed_texts(spark, listing, str(tmp_path / "texts"))
    assert sorted((r["title"], r["text"]) for r in found.collect()) == sorted(zip(titles, titles))
    assert lost.count() == 0


def test_topic_matrix_over_many_splits(spark, tmp_path):
    for topic, sub in ((0, "a"), (12, "a/b")):
        cells = "\n".join(f"-{topic}.{k:05d}" for k in range(1050))
        put(tmp_path / sub / f"topic-{topic:03d}-var-e-log-prob.dat", cells + "\n")
    put(tmp_path / "a" / "topic-001-info.dat", "9\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = readers.read_topic_matrix(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2100
    for row in got:
        assert row.logp == float(f"-{row.topic}.{row.term_idx * 100 + row.time_idx:05d}")
    assert {r.topic for r in got} == {0, 12}


def test_vocabulary_round_trip(spark, tmp_path):
    vocab = spark.createDataFrame([(1, "b"), (0, "don't"), (2, "c")], "idx long, token string")
    writers.write_vocabulary(vocab, str(tmp_path / "v"))
    assert get(tmp_path / "v") == ["0,don't", "1,b", "2,c"]
    got = readers.read_vocabulary(spark, str(tmp_path / "v"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, "don't"), (1, "b"), (2, "c")]


def test_title_overlap_job(spark, tmp_path):
    titles = put(tmp_path / "titles.txt", "A b\na-B\n")
    rows = [(1, "Ab!", "x\n\ty"), (2, "AB", "z"), (3, "C", "w")]
    pages = spark.createDataFrame(rows, "page_id long, title string, content string")
    jobs.title_overlap(titles, pages, str(tmp_path / "out"))
    assert sorted(get(tmp_path / "out")) == ["ab\tAB\tz", "ab\tAb!\tx y"]


def test_corpus_overlap_job(spark, tmp_path):
    selection = put(tmp_path / "sel.tsv", "a\tA\tx\n")
    corpus = put(tmp_path / "corpus.tsv", "a\tAA\ty z\nb\tB\tw\na\tAA\ty z\n")
    jobs.corpus_overlap(spark, selection, corpus, str(tmp_path / "out"))
    assert get(tmp_path / "out") == ["a\tAA\ty z"] * 2
    with pytest.raises(AnalysisException):
        jobs.corpus_overlap(spark, selection, corpus, str(tmp_path / "out"))


def test_year_jobs(spark, tmp_path):
    articles = put(tmp_path / "in.tsv", "a\tA\tin 1800 x\nb\tB\tno\nc\tC\t1800 and 1801\nd\tD\n")
    jobs.first_year_corpus(spark, articles, str(tmp_path / "years"))
    assert get(tmp_path / "years") == ["1800\tin 1800 x 1800 and 1801"]
    jobs.year_window_corpus(spark, articles, str(tmp_path / "windows"), margin=2)
    assert sorted(get(tmp_path / "windows")) == ["1800\tand", "1800\tin x", "1801\t1800 and"]


def test_sparse_corpus_and_sequence_jobs(spark, tmp_path):
    source = put(tmp_path / "in.tsv", "1902\t!!\n1900\tthe cat sat\n1901\tcat's cat 3rd\n1903\t\n")
    jobs.sparse_corpus(spark, source, str(tmp_path / "out"), by_year=True)
    assert get(tmp_path / "out-lookup") == ["0,cat", "1,cat's", "2,rd", "3,sat"]
    assert get(tmp_path / "out") == ["1900\t2 0:1 3:1", "1901\t3 0:1 1:1 2:1", "1902\t0 "]
    jobs.time_sequence(spark, source, str(tmp_path / "seq"))
    assert get(tmp_path / "seq") == ["3", "1", "1", "1"]


def test_topic_terms_job(spark, tmp_path):
    cells = [[-1.0, -3.0, -2.0][term] for term in range(3) for _ in range(100)]
    put(tmp_path / "run" / "topic-004-var-e-log-prob.dat", "\n".join(map(str, cells)) + "\n")
    lookup = put(tmp_path / "lookup", "0,high\n1,low\n2,middle\n")
    jobs.topic_terms(spark, lookup, str(tmp_path / "run"), str(tmp_path / "out"))
    got = get(tmp_path / "out")
    assert len(got) == 100 and got[0] == "4\t1800\tlow middle high" and got[-1] == "4\t1899\tlow middle high"


def test_year_arcs_job(spark, tmp_path):
    source = put(tmp_path / "circles.csv", "1800-1810,1.0\n1800-1850,2.718281828459045\nbad\n")
    jobs.year_arcs(spark, source, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def training_lines():
    themes = {1800: "ship sail mast harbour wind", 1900: "engine steam rail coal iron"}
    return "".join(f"{1800 if i % 2 else 1900}\t{themes[1800 if i % 2 else 1900]} common{i % 3}\n" for i in range(24))


def test_nearest_years_job_and_model_cache(spark, tmp_path):
    texts = put(tmp_path / "texts.tsv", training_lines() + "xxxx\tnothing\n1500\ttoo early\n")
    listing = put(tmp_path / "list.txt", "sea\t1805\nland\t1905\nempty\t1850\nlost\t1820\n")
    put(tmp_path / "dev" / "sea_clean.txt", "sail the ship\nbefore the wind mast mast harbour\n")
    put(tmp_path / "dev" / "land_clean.txt", "coal iron steam engine rail rail")
    put(tmp_path / "dev" / "empty_clean.txt", "zzz")
    options = {"k": 2, "iterations": 15}
    model = str(tmp_path / "model")
    got = jobs.nearest_years(spark, texts, listing, str(tmp_path / "dev"), model, **options).collect()
    assert {r.title: (r.actual_year, r.nearest_year) for r in got} == {
        "sea": (1805, 1800), "land": (1905, 1900), "empty": (1850, None), "lost": (1820, None)
    }
    assert [r.title for r in got if r.doc_id is None] == ["lost"]

    first = known_words(topic_model.TopicModel.load(spark, model))
    docs = spark.createDataFrame([(0, "other words here")], "doc_id long, text string")
    assert known_words(topic_model.load_or_train(docs, model, **options)) == first
    again = topic_model.load_or_train(docs, model, reset=True, **options)
    assert known_words(again) == ["here", "other", "words"]


def known_words(model):
    return sorted(r.token for r in model.words.select("token").collect())


def test_topic_model_shapes(spark):
    rows = [(i, line.split("\t")[1]) for i, line in enumerate(training_lines().splitlines())] + [(99, "1850 the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = topic_model.train(docs, k=3, iterations=5)
    total, mass = model.words.agg(F.sum("total"), F.sum(F.expr("aggregate(mass, 0D, (a, x) -> a + x)"))).first()
    assert mass == pytest.approx(total)
    thetas = {r.doc_id: r.theta for r in model.thetas(docs).collect()}
    assert all(sum(t) == pytest.approx(1.0) for i, t in thetas.items() if i != 99)
    unseen = spark.createDataFrame([(0, "zzz qqq"), (1, None), (2, "")], "doc_id long, text string")
    assert [r.theta for r in model.thetas(unseen, passes=2).collect()] == [[0.0] * 3] * 3
    listing = model.listing(4).orderBy("topic").collect()
    assert [r.topic for r in listing] == [0, 1, 2] and all(len(r.words.split()) == 4 for r in listing)
    assert all(r.weight > 0 for r in listing) and sum(r.weight for r in listing) == pytest.approx(1.0)


def test_topics_have_unequal_priors_that_are_saved(spark, tmp_path):
    docs = spark.createDataFrame([(i, "sea ship wave" if i % 10 else "corn field plough") for i in range(60)], "doc_id long, text string")
    model = topic_model.train(docs, k=2, alpha_sum=0.5, iterations=8)
    assert sum(model.prior) == pytest.approx(0.5) and max(model.prior) > 1.3 * min(model.prior)
    folded = model.thetas(docs, passes=3)
    shares = [r.theta for r in folded.collect()]
    assert model.learned_prior(folded) == pytest.approx([0.5 * sum(column) / len(shares) for column in zip(*shares)])
    assert model.learned_prior(folded.limit(0)) == model.prior
    model.save(str(tmp_path / "model"))
    again = topic_model.TopicModel.load(spark, str(tmp_path / "model"))
    assert again.prior == model.prior and again.listing().count() == 2
    old = spark.read.parquet(str(tmp_path / "model" / "versions")).drop("prior").withColumn("version", F.lit(2).cast("long"))
    old.write.mode("append").parquet(str(tmp_path / "model" / "versions"))
    assert topic_model.TopicModel.load(spark, str(tmp_path / "model")).prior == [0.25, 0.25]


def test_folding_in_goes_on_with_moving_documents_only(spark, monkeypatch):
    words = "sea ship wave corn field plough king queen crown".split()
    texts = [" ".join(words[(i * j) % 9] for j in range(1, 3 + i % 40)) for i in range(80)] + ["unknown"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = topic_model.train(docs.where("doc_id < 80"), k=3, iterations=4)
    work = []
    expected = topic_model.TopicModel.expected

    def counting(self, counted, thetas, doc_id):
        work.append((counted.count(), None if thetas is None else thetas.count()))
        return expected(self, counted, thetas, doc_id)

    monkeypatch.setattr(topic_model.TopicModel, "expected", counting)
    got = {r.doc_id: r.theta for r in model.thetas(docs, passes=10, tolerance=1e-2).collect()}
    moving = [n for _, n in work[1:]]
    assert moving == sorted(moving, reverse=True) and moving[-1] < moving[0] and work[-1][0] < work[0][0]
    del work[:]
    whole = {r.doc_id: r.theta for r in model.thetas(docs, passes=10, tolerance=-1.0).collect()}
    assert {n for _, n in work[1:]} == {80} and got.keys() == whole.keys()
    assert got[80] == whole[80] == [0.0] * 3
    assert all(got[i] == pytest.approx(whole[i], abs=0.1) and sum(got[i]) == pytest.approx(1.0) for i in range(80))
    assert {tuple(r.theta) for r in model.thetas(docs, passes=0).collect()} == {(0.0, 0.0, 0.0)}
    assert model.thetas(docs.limit(0)).collect() == []


def test_words_are_looked_up_once_for_all_passes(spark, monkeypatch):
    """Each pass joined the words of all blocks with the model anew, and documents that had just been counted were counted again."""
    monkeypatch.setattr(blocks, "PACKED_WORDS", 4)
    words = "sea ship wave corn field plough king queen crown".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 9] for j in range(1, 3 + i % 40))) for i in range(80)], "doc_id long, text string")
    model = topic_model.train(docs, k=3, iterations=3)
    looked_up, counted = topic_model.TopicModel.looked_up, topic_model.document_words
    calls = []
    monkeypatch.setattr(topic_model.TopicModel, "looked_up", lambda self, c: calls.append("looked up") or looked_up(self, c))
    monkeypatch.setattr(topic_model, "document_words", lambda *a, **b: calls.append("counted") or counted(*a, **b))
    anew = {r.doc_id: r.theta for r in model.thetas(docs, passes=4, tolerance=-1.0).collect()}
    assert calls == ["counted", "looked up"]
    again = {r.doc_id: r.theta for r in model.thetas(docs, passes=4, tolerance=-1.0, counted=model.counted).collect()}
    assert calls == ["counted", "looked up", "looked up"]
    assert anew.keys() == again.keys() and all(again[i] == pytest.approx(anew[i], abs=1e-12) for i in anew)
    # Without the packed lookups, pass by pass.
    plain, shares = topic_model.document_words(docs, with_words=False), None
    for _ in range(4):
        shares = model.document_shares(model.expected(plain, shares, "doc_id"), "doc_id")
    for r in shares.collect():
        assert anew[r.doc_id] == pytest.approx(r.theta, abs=1e-12)


def test_topic_model_without_words(spark):
    docs = spark.createDataFrame([(0, "1850")], "doc_id long, text string")
    model = topic_model.train(docs, k=3, iterations=2)
    assert model.listing().collect() == [] and model.thetas(docs).first().theta == []


def test_html_pages(spark):
    html = "<html><title>T &amp; x</title><script>a<b</script><p>one<br>two</p></html>"
    row = readers.html_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert row.title == "T &amp; x" and row.content.split() == ["T", "&amp;", "x", "one", "two"]


def test_number_lines_without_a_single_task_per_file(spark):
    df = spark.createDataFrame([("f", 0, 10), ("f", 0, 11), ("f", 50, 3), ("g", 0, 7)], "file string, split long, place long")
    got = readers.number_lines(df).select("file", "split", "place", F.col("line")).collect()
    assert sorted(tuple(r) for r in got) == [("f", 0, 10, 0), ("f", 0, 11, 1), ("f", 50, 3, 2), ("g", 0, 7, 0)]


def test_line_ids_are_the_same_in_each_reading(spark, tmp_path, monkeypatch):
    for name in "ab":
        put(tmp_path / f"{name}.txt", "".join(f"{name} {i}\n" for i in range(500)))
    monkeypatch.setattr(readers, "materialize", lambda df: pytest.fail("lines were written"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        first, second = (readers.read_identified_lines(spark, str(tmp_path)).collect() for _ in range(2))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(first) == sorted(second) and len({r.line_id for r in first}) == 1000
    for name in "ab":
        own = [r.value for r in sorted(first) if r.value.startswith(name)]
        assert own == [f"{name} {i}" for i in range(500)]


def test_ordered_lines_and_trainer_documents(spark, tmp_path):
    rows = [(i, 1900 - i // 7, [(i, 1)] if i % 5 else []) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, year int, terms array<struct<idx:long,n:long>>")
    writers.write_trainer_documents(docs.repartition(5), str(tmp_path / "out"))
    got = sorted(tuple(r) for r in readers.read_ordered_lines(spark, str(tmp_path / "out")).collect())
    want = [f"1 {i}:1" if i % 5 else "0 " for i, year, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert got == list(enumerate(want))


def test_a_failed_save_leaves_the_model_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    docs = lambda text: spark.createDataFrame([(0, text)], "doc_id long, text string")
    options = {"k": 2, "iterations": 1}
    topic_model.load_or_train(docs("first words"), path, **options)
    broken = topic_model.train(docs("second try"), **options)
    stop = F.udf(lambda x: 1 / 0, "long")
    broken.words = broken.words.withColumn("total", stop("total"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        broken.save(path)
    assert known_words(topic_model.load_or_train(docs("x"), path, **options)) == ["first", "words"]
    topic_model.load_or_train(docs("third model"), path, reset=True, **options)
    assert known_words(topic_model.TopicModel.load(spark, path)) == ["model", "third"]
    with pytest.raises(FileNotFoundError):
        topic_model.TopicModel.load(spark, str(tmp_path / "none"))
