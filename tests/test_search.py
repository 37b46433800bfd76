import io
import random
from contextlib import redirect_stdout
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliary.catalog import fixtures
from foliary.catalog.queries import QUERIES
from foliary.operators import grouping
from foliary.operators import search as ops
from foliary.operators import topk
from foliary.operators.analyze import _known, analyze, by_field, by_term, postings, row_stats, term_rows, term_stats
from foliary.plans.search import (
    current_index,
    extend_index,
    open_index,
    rebuild_index,
    search,
    search_hits,
    search_totals,
    weighted_terms,
    write_index,
)
from foliary.schemas import CORPUS
from foliary.session import new_path
from foliary.settings import Settings
from tests import model

SETTINGS = Settings()
EXACT = replace(SETTINGS, fuzzy=False)
# Every lookup takes the salted path and every block with two words is cut.
SALTED = replace(SETTINGS, broadcast_rows=0, salts=3, rows_per_task=1)


def documents(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "filename string, content string")
    df = df.withColumn("sha256", F.sha2("content", 256)).withColumns(
        {
            "s3_bucket": F.lit("documents"),
            "s3_key": F.concat(F.lit("documents/"), "filename"),
            "size_bytes": F.octet_length("content").cast("long"),
        }
    )
    for field in CORPUS.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*CORPUS.fieldNames())


TEXTS = {
    "rules.pdf": model.RULES,
    "vzkaz-c-1.pdf": model.NOTE,
    "the-notes.txt": "alpha beta. alpha gamma! beta beta? delta delta delta\n" + "long word " * 50 + "alpha omega.",
    "hidden.txt": "nothing to see",
}


@pytest.fixture(scope="module")
def index(spark):
    lemmas = spark.createDataFrame(model.LEMMAS + [("beta", "beta"), ("beta", "bet")], "surface string, lemma string")
    path = new_path(spark, "test-index")
    write_index(documents(spark, TEXTS), path, lemmas, SETTINGS)
    return open_index(spark, path)


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, q string")


def found(spark, index, query, settings=SETTINGS):
    rows = search_hits(ask(spark, query), index, settings=settings).orderBy("rank").collect()
    return [r.filename for r in rows]


def test_lemmas_alone(spark, index):
    assert set(found(spark, index, "knihám", EXACT)) == {"rules.pdf", "vzkaz-c-1.pdf"}


def test_folding_alone(spark, index):
    assert found(spark, index, "pujcuje", EXACT) == ["rules.pdf"]
    assert found(spark, index, "stiznosti", EXACT) == ["rules.pdf"]


@pytest.mark.parametrize("query", ["knhiovna", "pokuda"])
def test_typos(spark, index, query):
    assert "rules.pdf" in found(spark, index, query)
    assert found(spark, index, query, EXACT) == []


def test_highlight_of_two_words(spark, index):
    hit = search_hits(ask(spark, '"přijímá vedoucí"'), index).first()
    assert hit.filename == "rules.pdf"
    assert hit.highlights == [
        "Stížnosti <em>přijímá</em> <em>vedoucí</em> oddělení každé pondělí ráno."
    ]


def test_quotes_mean_nothing(spark, index):
    page = search(ask(spark, '"alpha beta"', "alpha beta"), index).orderBy("query_id", "rank")
    rows = [(r.query_id, r.sha256, r.score) for r in page.collect()]
    assert [r[1:] for r in rows if r[0] == 0] == [r[1:] for r in rows if r[0] == 1]


def test_stop_words_still_match_plain_fields(spark, index):
    # `to` is a Czech stop word: gone from the lemma field, present in the others.
    assert found(spark, index, "to", EXACT) == ["hidden.txt"]


def test_name_hit_has_no_fragments(spark, index):
    hit = search_hits(ask(spark, "hidden.txt"), index).first()
    assert (hit.filename, hit.highlights) == ("hidden.txt", [])


def test_fragments_are_short_few_and_in_order(spark, index):
    hit = search_hits(ask(spark, "alpha beta"), index, settings=EXACT).first()
    assert hit.highlights[0] == "<em>alpha</em> <em>beta</em>."
    assert len(hit.highlights) == 3
    assert all(len(h.replace("<em>", "").replace("</em>", "")) <= 201 for h in hit.highlights)


def test_totals_and_pages(spark, index):
    queries = ask(spark, "kniha", "nothingness")
    totals = {r.query_id: r.total for r in search_totals(queries, index).collect()}
    assert totals[0] >= 2 and totals[1] == 0
    wide = replace(SETTINGS, max_page_size=500)
    assert search(queries, index, 0, 500, wide).count() == totals[0]
    assert search_totals(queries, index, cap=1).filter("query_id = 0").first().total == 1
    first, second = (search(queries, index, offset, 1).filter("query_id = 0").first() for offset in (0, 1))
    assert (first.rank, second.rank) == (1, 2) and first.score >= second.score
    for offset, size in ((-1, 1), (0, 0), (0, 101)):
        with pytest.raises(ValueError):
            search(queries, index, offset, size)


def test_salted_equals_broadcast(spark, index):
    queries = ask(spark, "knhiovna beta", "pokuda", "vzkza cislo knihám", "delta worrd")
    plain = search(queries, index, settings=SETTINGS).collect()
    salted = search(queries, index, settings=SALTED).collect()
    key = lambda r: (r.query_id, r.rank)
    assert sorted(plain, key=key) == sorted(salted, key=key) and plain


def test_salted_analysis(spark, index):
    texts = documents(spark, TEXTS)
    rows = [analyze(texts, index.lemmas, s).collect() for s in (SETTINGS, SALTED)]
    assert sorted(rows[0]) == sorted(rows[1])
    posts = [postings(texts, index.lemmas, s).collect() for s in (SETTINGS, SALTED)]
    assert sorted(posts[0]) == sorted(posts[1])


@pytest.mark.parametrize("settings", [SETTINGS, SALTED])
def test_fuzzy_terms_against_all_pairs(spark, settings):
    rng = random.Random(11)
    letters = "aábcd"
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(1500)})
    stems = rng.sample(words, 40)
    vocabulary = spark.createDataFrame(
        [(f, w, 1, 1, 1) for f in ("x", "y") for w in words],
        "field string, term string, doc_freq long, total_tf long, opens long",
    )
    asked = []
    for stem in stems + ["abcdabcdabcdabcd", "ab", "a", "cabdabcdacbd"]:
        edits = 0 if len(stem) <= 2 else 1 if len(stem) <= 5 else 2
        asked.append(("x", stem, edits))
    # Words close to long ones, so that the long blocks are met as well.
    for stem in [s for s in words if len(s) > 10][:15]:
        at = rng.randrange(1, len(stem) - 2)
        swapped = stem[:at] + stem[at + 1] + stem[at] + stem[at + 2 :]
        asked += [("x", swapped[:-1], 2), ("x", swapped[:2] + "a" + swapped[2:], 2)]
    asked = sorted(set(asked))
    wanted = spark.createDataFrame(asked, "field string, query_term string, edits int")
    unlimited = replace(settings, max_expansions=10_000)
    got = ops.fuzzy_terms(wanted, vocabulary, settings is SETTINGS, unlimited)
    got = {(r.field, r.query_term, r.term): r.distance for r in got.collect()}
    expected = {}
    for field, query, edits in asked:
        for word in words:
            if word == query or (edits and word[0] == query[0] and abs(len(word) - len(query)) <= edits):
                distance = model.swap_distance(query, word)
                if distance <= edits:
                    expected[field, query, word] = distance
    assert got == expected


def test_best_expansions_are_kept(spark):
    words = ["abcdef"] + [f"abcde{c}" for c in "ghij"]
    vocabulary = spark.createDataFrame(
        [("x", w, 1, 1, 1) for w in words],
        "field string, term string, doc_freq long, total_tf long, opens long",
    )
    wanted = spark.createDataFrame([("x", "abcdef", 2)], "field string, query_term string, edits int")
    few = replace(SETTINGS, max_expansions=3)
    got = [r.term for r in ops.fuzzy_terms(wanted, vocabulary, True, few).orderBy("term").collect()]
    assert got == ["abcdef", "abcdeg", "abcdeh"]


def test_index_in_parts_equals_whole(spark, index):
    path = new_path(spark, "test-index")
    texts = documents(spark, TEXTS)
    write_index(texts.filter("filename LIKE '%.txt'"), path, index.lemmas, SETTINGS)
    extend_index(texts.filter("filename <> 'rules.pdf'"), path, SETTINGS)
    whole = extend_index(texts, path, SETTINGS)
    assert whole.corpus.count() == len(TEXTS)
    again = extend_index(texts, path, SETTINGS)
    assert again.postings.count() == index.postings.count()
    assert sorted(again.fields.collect()) == sorted(index.fields.collect())
    queries = ask(spark, "knhiovna beta", "pokuda", "dilnu vazba")
    assert sorted(search(queries, again).collect()) == sorted(search(queries, index).collect())


def test_renamed_document_equals_a_fresh_index(spark, index):
    texts, path = documents(spark, TEXTS), new_path(spark, "test-index")
    write_index(texts, path, index.lemmas, SETTINGS)
    moved = texts.filter("filename = 'rules.pdf'").withColumns(
        {"filename": F.lit("loans.pdf"), "s3_key": F.lit("documents/loans.pdf")}
    )
    after = extend_index(moved, path, SETTINGS)
    assert extend_index(moved, path, SETTINGS).postings.count() == after.postings.count()
    other = texts.filter("filename <> 'rules.pdf'").unionByName(moved)
    fresh = rebuild_index(other, new_path(spark, "test-root"), index.lemmas, SETTINGS)
    assert after.corpus.count() == len(TEXTS)
    columns = ["field", "term", "doc_freq", "total_tf"]
    assert sorted(after.vocabulary.select(columns).collect()) == sorted(fresh.vocabulary.select(columns).collect())
    assert sorted(after.fields.collect()) == sorted(fresh.fields.collect())
    queries = ask(spark, "knihu beta", "rules", "loans")
    assert sorted(search(queries, after).collect()) == sorted(search(queries, fresh).collect())
    assert found(spark, after, "knihu", EXACT)[0] == "loans.pdf" and found(spark, after, "rules", EXACT) == []


def test_rebuild_switches_when_it_is_whole(spark, index):
    root, texts = new_path(spark, "test-root"), documents(spark, TEXTS)
    with pytest.raises(ValueError):
        current_index(spark, root)
    rebuild_index(texts.limit(1), root, index.lemmas, SETTINGS)
    assert current_index(spark, root).corpus.count() == 1
    rebuild_index(texts, root, index.lemmas, SETTINGS)
    assert current_index(spark, root).corpus.count() == len(TEXTS)


def plan_of(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_plan(spark, index):
    page = search(ask(spark, "kniha pokuta"), index)
    plan = plan_of(page)
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan
    assert "dynamicpruning" in plan
    weighted = weighted_terms(ask(spark, "kniha"), index)
    assert weighted.count() > 0


class TestSkippedPostings:
    """A page found with skipped terms equals one over all matches."""

    @pytest.fixture(scope="class")
    def crowd(self, spark):
        rng = random.Random(5)
        words = [a + b + c for a in "bdkl" for b in "aeo" for c in ("ra", "lin", "som", "tak")]
        often = [1 / (i + 1) for i in range(len(words))]
        texts = {
            f"{i}.txt": " ".join(rng.choices(words, often, k=rng.randrange(1, 60))) + f" only{i % 40}" for i in range(400)
        }
        path = new_path(spark, "test-index")
        forms = spark.createDataFrame([("bara", "x"), ("bara", "balin"), ("dara", "dalin")], "surface string, lemma string")
        docs = documents(spark, texts)
        write_index(docs.filter("filename NOT LIKE '1%'"), path, forms, SETTINGS)
        queries = [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(12)]
        return extend_index(docs, path, SETTINGS), ask(spark, *queries, "only7 bara dara", "bara", "nothing", "BARA balin only39")

    @pytest.mark.parametrize("change", [{}, {"k1": 0.5, "b": 0.0}, {"k1": 2.0, "b": 1.0}, {"broadcast_rows": 0, "salts": 3}])
    def test_equal_pages(self, crowd, monkeypatch, change):
        index, queries = crowd
        monkeypatch.setattr(topk, "SEED_ROWS", 2)
        monkeypatch.setattr(topk, "SEED_DOCUMENTS", 2)
        settings = replace(SETTINGS, **change)
        for offset, size in ((0, 3), (4, 5)):
            whole = search(queries, index, offset, size, settings).collect()
            found = search(queries, index, offset, size, replace(settings, prune_rows=0)).collect()
            assert sorted(found) == sorted(whole) and whole

    def test_no_share_exceeds_its_bound(self, spark, crowd):
        index, queries = crowd
        for settings in (SETTINGS, replace(SETTINGS, k1=0.4, b=0.2), replace(SETTINGS, k1=3.0, b=0.9)):
            weighted = weighted_terms(queries, index, settings)
            scores = ops._contributions(weighted.filter("unit <> ''"), index.postings, settings)
            most = topk.units(weighted, settings).groupBy("query_id", "field").agg(F.sum("most").alias("most"))
            got = scores.groupBy("query_id", "field", "sha256").agg(F.sum("score").alias("score"))
            boosts = F.create_map(*[F.lit(x) for p in settings.field_boosts.items() for x in p])
            over = got.join(most, ["query_id", "field"]).filter(F.col("score") * boosts[F.col("field")] > F.col("most") + 1e-9)
            assert over.isEmpty()

    def test_fewer_postings_are_met(self, crowd, monkeypatch):
        index, queries = crowd
        weighted = weighted_terms(queries, index, EXACT)
        units = topk.units(weighted, EXACT)
        limits = topk.thresholds(weighted, ops.score_columns(weighted, index.postings, EXACT)[0], index.postings, 3, EXACT)
        left_out = topk.skipped(units, limits).agg(F.sum("rows")).first()[0]
        assert left_out > 0.3 * units.agg(F.sum("rows")).first()[0]


def exchanged(df):
    """The lines of the plan that move rows."""
    with redirect_stdout(io.StringIO()) as shown:
        df.explain()
    return [line for line in shown.getvalue().splitlines() if "Exchange" in line]


def test_terms_are_not_moved(spark, index):
    # One exchange for the texts of each branch, by hash, and none for their words.
    texts = documents(spark, TEXTS)
    rows = analyze(texts, None, SETTINGS).groupBy("sha256", "field").count()
    moved = exchanged(rows)
    assert moved and all("pos" not in line and "term" not in line for line in moved)


def test_tasks_follow_the_text(spark):
    texts = documents(spark, {f"{n}.txt": f"word{n} " * 40 for n in range(20)})
    small = replace(SETTINGS, text_bytes=500)
    assert postings(texts, None, small).rdd.getNumPartitions() >= 10


def test_one_posting_row_for_all_fields(spark):
    path = new_path(spark, "test-index")
    index = write_index(documents(spark, {"a.txt": "alpha beta béta"}), path, None, SETTINGS)
    assert spark.read.parquet(f"{path}/segment-000001/postings").filter("term = 'alpha'").count() == 1
    found = sorted((r.field, r.term, r.tf, r.dl) for r in index.postings.collect() if r.term in ("alpha", "beta"))
    assert found == [
        ("content", "alpha", 1, 3), ("content", "beta", 1, 3), ("content.folded", "alpha", 1, 3),
        ("content.folded", "beta", 2, 3), ("content.raw", "alpha", 1, 3), ("content.raw", "beta", 1, 3),
    ]


def test_lemmatize_cuts_the_texts_once(spark, monkeypatch):
    calls = []

    def vocabulary(*_):
        calls.append(1)
        return spark.createDataFrame([("walking",), ("the",), ("madly",)], "word string")

    monkeypatch.setattr(fixtures, "vocabulary", vocabulary)
    rows = QUERIES["lemmatize"](spark, "unused").collect()
    assert sorted(map(tuple, rows)) == [("madly", "mad"), ("madly", "madly"), ("the", "the"), ("walking", "walk")]
    assert len(calls) == 1


def test_large_dictionaries_do_not_move_words(spark):
    texts = documents(spark, {"a.txt": "reading words reading", "b.txt": "Reading maps"})
    lemmas = spark.createDataFrame([("Reading", "read"), ("maps", "map"), ("maps", "maps")], "surface string, lemma string")
    large = replace(SETTINGS, broadcast_rows=1)
    rows = postings(texts, lemmas, large)
    moved = exchanged(rows)
    assert moved and all("_salt" not in line and "sha256" not in line for line in moved)
    assert sorted(rows.collect()) == sorted(postings(texts, lemmas, SETTINGS).collect())


def test_hashes_move_once_for_a_bucket(spark):
    texts = documents(spark, {"a.txt": " ".join(f"word{n}" for n in range(40))})
    packed = term_rows(texts, None, SETTINGS, positions=False, buckets=2)
    assert packed.count() <= 4
    columns = packed.drop("bucket").columns
    flat = term_rows(texts, None, SETTINGS, positions=False).select(columns)
    assert sorted(map(repr, by_term(packed).select(columns).collect())) == sorted(map(repr, flat.collect()))


def test_copies_are_found_without_moving_texts(spark):
    path = new_path(spark, "test-copies")
    rows = [(1, "one", "en", "s"), (2, "two", "en", "s"), (3, "one", "de", "t"), (4, None, "en", "s"), (None, "two", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    found = fixtures.corpus(spark, path)
    assert all("doc_id" not in line for line in exchanged(found))
    assert sorted((r.content, r.filename) for r in found.collect()) == [("one", "3-de.txt"), ("two", "2-en.txt")]


def test_terms_move_as_one_text_and_fields_as_one_row(spark):
    """Terms of a document and bucket move packed; the vocabulary moves a row for a term, not for each field."""
    texts = documents(spark, {"a.txt": 'reading "read" été ete', "b.txt": "reading maps"})
    lemmas = spark.createDataFrame([("reading", "read"), ("maps", 'a "map"\\\n'), ("maps", "maps")], "surface string, lemma string")
    packed = term_rows(texts, lemmas, SETTINGS, positions=False, buckets=2)
    assert dict(packed.dtypes)["term"] == "string"
    rows = by_term(packed)
    lengths = {"content.raw": 3.0, "content": 3.5, "content.folded": 3.0}
    found = row_stats(rows, lengths)
    assert all("field" not in line for line in exchanged(found.select("field", "term", "doc_freq")) if "hashpartitioning" in line)
    plain = term_stats(by_field(rows), lengths).select(found.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    assert {r.term for r in found.collect()} >= {'a "map"\\\n', "été", "ete"}


def test_hashes_of_arrow_equal_those_of_sql(spark):
    rng = random.Random(3)
    texts = ["", "a", "é", "word", *("".join(rng.choices("abcžý日𝐀_9", k=n)) for n in range(90)), "x" * 255]
    values = pa.array(["unused", *texts, "unused"]).slice(1, len(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", F.xxhash64("t").alias("h"))
    assert grouping.xxhash64(values).tolist() == [r.h for r in df.orderBy("n").collect()]


def test_words_take_no_row_each(spark):
    """Neither the words of texts nor their positions are rows, with a large dictionary too."""
    texts = documents(spark, {"a.txt": "reading words reading", "b.txt": "Reading maps"})
    lemmas = spark.createDataFrame([("Reading", "read"), ("maps", "map"), ("maps", "maps")], "surface string, lemma string")
    large = replace(SETTINGS, broadcast_rows=1)
    for rows in (postings(texts, lemmas, large), analyze(texts, lemmas, large, listed=True)):
        moved = exchanged(rows)
        assert moved and all("_salt" not in line and "sha256" not in line for line in moved)
        with redirect_stdout(io.StringIO()) as shown:
            rows.explain()
        assert "Window" not in shown.getvalue() and "posexplode_outer(regexp" not in shown.getvalue()
    listed = analyze(texts, lemmas, large, listed=True).select("sha256", "field", F.inline("terms"))
    plain = analyze(texts, lemmas, SETTINGS)
    assert sorted(listed.collect()) == sorted(plain.collect()) and plain.count() == 18


@pytest.mark.parametrize("limit", [1, 1000])
def test_repeated_rows_odd_lemmas_and_long_words(spark, limit):
    """Rows of a hash add up, a text's length does not; words are cut at 255 characters; lemmas are any text."""
    long = "é" * 300
    texts = documents(spark, {"a.txt": f"of maps été ete {long}", "b.txt": "-", "c.txt": "maps"})
    texts = texts.unionByName(texts.filter("filename = 'a.txt'")).unionByName(texts.limit(1).withColumns({c: F.lit(None).cast("string") for c in ("content", "filename")}))
    lemmas = [("maps", ""), ("maps", 'a\nb"'), ("été", "ete"), ("of", "never"), ("nothing", "x"), ("ete", None)]
    lemmas = spark.createDataFrame(lemmas, "surface string, lemma string")
    settings = replace(SETTINGS, stopwords=("of",), broadcast_rows=limit)
    flat = term_rows(texts, lemmas, settings)
    rows = {(r.term, r.dl, r.kept_dl): r for r in flat.filter("tf_3 IS NULL").collect()}
    assert {t for t, dl, _ in rows if dl == 6} == {"of", "maps", "été", "ete", "é" * 255, "é" * 45, "e" * 255, "e" * 45, "", 'a\nb"'}
    counts = lambda term, dl=6, kept=5: tuple(rows[term, dl, kept][f"tf_{i}"] for i in range(3))
    assert [counts(t) for t in ("of", "maps", "été", "ete")] == [(2, None, 2), (2, None, 2), (2, None, None), (2, 2, 4)]
    assert counts("") == counts('a\nb"') == (None, 2, None) and counts("", 1, 1) == (None, 1, None)
    assert (rows["of", 6, 5].opens, rows["", 6, 5].opens, rows['a\nb"', 6, 5].opens) == (5, 2, 0)
    assert rows["ete", 6, 5].positions.asDict() == {"p0": [3, 3], "p1": [2, 2], "p2": [2, 2, 3, 3], "p3": []}
    packed = term_rows(texts, lemmas, settings, positions=False, buckets=3)
    columns = packed.drop("bucket").columns
    assert sorted(map(repr, by_term(packed).select(columns).collect())) == sorted(map(repr, flat.select(columns).collect()))
    named = analyze(texts, lemmas, settings).filter("field <> 'filename'").groupBy("field").agg(F.count("*").alias("n"))
    assert {r.field: r.n for r in named.collect()} == {"content.raw": 13, "content.folded": 13, "content": 12}


def test_words_that_a_dictionary_lacks_are_not_asked_for(spark):
    words = [f"word{n}" for n in range(3000)]
    lemmas = spark.createDataFrame([("WORD7", "seven"), (None, "x"), ("word0", "nought"), ("other", "y")], "surface string, lemma string")
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5, 4]), pa.array(["\n".join(words), "word7\nword8", "word7"])], names=["part", "words"])
    rows = [tuple(r.values()) for b in grouping.asked_words(iter([batch]), _known(lemmas)) for r in b.to_pylist()]
    assert len(set(rows)) == len(rows) < 50 and set(rows) >= {(4, "word7"), (4, "word0"), (5, "word7")}


def test_counted_blocking_keys_are_broadcast(spark, index):
    """Many query words have fewer blocking keys than they might: these are counted before words of the vocabulary move."""
    wanted = spark.createDataFrame([("content.raw", w, 1) for w in ("alpah", "bate", "gama")], "field string, query_term string, edits int")
    found = ops.fuzzy_terms(wanted, index.vocabulary, True, replace(SETTINGS, broadcast_rows=200))
    assert all("key" not in line for line in exchanged(found) if "hashpartitioning" in line)
    plain = ops.fuzzy_terms(wanted, index.vocabulary, False, SALTED)
    key = lambda rows: sorted((r.query_term, r.term, r.distance) for r in rows.collect())
    assert key(found) == key(plain) and {r[:2] for r in key(found)} >= {("alpah", "alpha"), ("gama", "gamma")}


def test_queries_take_their_words_out_of_a_large_dictionary(spark):
    lemmas = spark.createDataFrame([("Reading", "read"), *[(f"w{n}", f"v{n}") for n in range(50)]], "surface string, lemma string")
    terms = ops.query_terms(ask(spark, "reading w7"), lemmas, replace(SETTINGS, broadcast_rows=20))
    assert all("_salt" not in line for line in exchanged(terms))
    assert {r.term for r in terms.filter("field = 'content'").collect()} == {"read", "v7"}


def test_postings_of_other_terms_are_dropped_before_their_fields(spark, index):
    weighted = weighted_terms(ask(spark, "alpha"), index, EXACT)
    with redirect_stdout(io.StringIO()) as shown:
        ops._contributions(weighted, index.postings, EXACT).explain()
    plan = shown.getvalue()
    assert plan.index("Generate inline") < plan.rindex("LeftSemi")
