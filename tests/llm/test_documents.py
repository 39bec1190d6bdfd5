"""Operators on documents against brute force, with odd rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_helpers import items_found, near_classes, removed_bytes
from tickloom.llm import decontaminate, langid, line_dedup, ngram_join, packing, stages, suffix_dedup, token_counts, toxicity

TOKENIZER = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("slice_bytes", [2 << 20, 700])
def test_repeated_passages(odd_docs, slice_bytes):
    got = suffix_dedup.remove_repeats(odd_docs, length=40, slice_bytes=slice_bytes).collect()
    want = removed_bytes([((t or "").encode()) for _, t in texts(odd_docs)], 40)
    rows = Counter((i, *w) for (i, _), w in zip(texts(odd_docs), want))
    assert Counter(tuple(r) for r in got) == rows
    assert sum(w[1] for w in want) > 5000


def test_buckets_follow_the_bytes(odd_docs, monkeypatch):
    """Far more buckets than partitions give the same results."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(token_counts, "BUCKET_BYTES", 1000)
    rows = texts(odd_docs)
    want = removed_bytes([((t or "").encode()) for _, t in rows], 40)
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(odd_docs, length=40).collect()) == Counter((i, *w) for (i, _), w in zip(rows, want))
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd_docs).collect())
    assert got == Counter((i, len(ids(t))) for i, t in rows)


def test_repeated_passages_keep_the_rest(odd_docs):
    for r in suffix_dedup.remove_repeats(odd_docs, length=40, with_text=True).collect():
        assert hashlib.sha256(bytes(r.kept_text)).hexdigest() == r.kept_sha256
        assert len(r.kept_text) == r.n_bytes - r.n_removed


def test_token_counts(odd_docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd_docs, limit=100).collect())
    assert got == Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 100) for i, t in texts(odd_docs))


def test_packing_places_every_token_once(odd_docs):
    pieces = packing.token_pieces(odd_docs, capacity=64)
    rows = packing.pack(pieces, capacity=64).collect()
    want = Counter()
    for i, t in texts(odd_docs):
        full = [*ids(t), 1]
        for k, at in enumerate(range(0, len(full), 64)):
            part = full[at: at + 64]
            want[i, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 2


def test_packing_replaces_the_smallest_by_two():
    # 60 leaves 40: greedy takes 35, but 25 + 15 fill the gap
    assert sorted(sorted(p) for p, _ in packing.plan({60: 1, 35: 1, 25: 1, 15: 1}, 100)) == [[15, 25, 60], [35]]
    counts = {int(k): int(n) for k, n in zip(range(1, 65), np.random.default_rng(1).integers(0, 50, 64))}
    used = Counter()
    for pattern, times in packing.plan(counts, 64):
        assert sum(pattern) <= 64
        for length in pattern:
            used[length] += times
    assert used == Counter({k: n for k, n in counts.items() if n})


def test_similar_documents(odd_docs):
    got = ngram_join.near_duplicates(odd_docs, block=2).collect()
    links, groups = near_classes([t for _, t in texts(odd_docs)], 0.8)
    want = Counter()
    names = [i for i, _ in texts(odd_docs)]
    for k, (i, _) in enumerate(texts(odd_docs)):
        inside = [names[m] for m in groups[k] if names[m] is not None]
        want[i, min(inside) if inside else None, links[k]] += 1
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert sum(r.kept for r in got) == len({tuple(g) for g in groups})
    assert max(links) >= 4


def test_one_of_each_class_stays(odd_docs):
    got = ngram_join.keep_one(odd_docs)
    assert got.columns == odd_docs.columns
    _, groups = near_classes([t for _, t in texts(odd_docs)], 0.8)
    assert got.count() == len({tuple(g) for g in groups})


def test_prefixes_are_shortened_to_the_recall():
    assert ngram_join.depths() == [8, 7] and ngram_join.recall_at(7) >= ngram_join.RECALL > ngram_join.recall_at(8)
    assert ngram_join.depths(0.8, 4, 8, 0.999)[-1] < 4 and ngram_join.depths(0.8, 32, 8, 0.5) == [8]


def made_words(seed, n):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10 ** 9, n)]


def test_pages_of_one_template_do_not_chain(spark):
    """400 pages share 70 % of their words with all others, and no two are near: no group is verified pair by pair."""
    head = made_words(0, 140)
    pages = [(k, " ".join([*head, *made_words(k + 1, 60)])) for k in range(400)]
    pages += [(1000 + k, " ".join([*made_words(5000, 200)[:-1], f"end{k}"])) for k in range(3)]
    docs = spark.createDataFrame(pages, "row long, text string")
    signed = ngram_join.signatures(docs, "row", "text").withColumnRenamed("row", "rep").select("rep", "labels").cache()
    groups = ngram_join._candidate_groups(signed, 0.8, ngram_join.TREES, ngram_join.LABEL, ngram_join.RECALL)
    assert sorted(map(tuple, groups.collect())) == [(1000 + k, 1000) for k in range(3)]
    blocked = ngram_join._candidate_groups(signed, 0.8, ngram_join.TREES, ngram_join.LABEL, ngram_join.RECALL, block=50)
    assert sorted(map(tuple, blocked.collect())) == [(1000 + k, 1000) for k in range(3)]


def test_recall_of_planted_pairs(spark):
    """Pairs at a similarity from 0.8 on are found; 300 of them lie right at the threshold."""
    rows = []
    for k in range(600):
        words = made_words(10_000 + k, 204)  # 200 shingles; the last n words differ
        n = 22 if k < 300 else 5 + k % 17
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-n], *made_words(50_000 + k, n)]))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (200 - 22) / (200 + 22) >= 0.8 > (200 - 23) / (200 + 23)
    assert sum(r.n_links == 1 for r in got) >= 0.995 * 1200 and all(r.class_id // 2 == r.doc_id // 2 for r in got)


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_contamination(spark, odd_docs, part_bytes):
    base = [t for i, t in texts(odd_docs) if i == 1][0].split()
    items = [(1, " ".join(base[20:45])), (2, " ".join(base[40:52]).upper()), (3, "one TWO"), (4, None), (5, "?!"), (6, " ".join(base[20:45])),
             (7, "not there at all"), (None, " ".join(base[0:10])), (8, "x" * 3000)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    parts = decontaminate.automata(frame, part_bytes=part_bytes)
    assert len(parts) > 1 or part_bytes > 1000
    got = decontaminate.contamination(odd_docs, parts).collect()
    want = Counter()
    for i, t in texts(odd_docs):
        n, hit, found = items_found(t, items, 10)
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        want[i, n, hit, len([x for x in found if x is not None]), hashlib.sha256(listed.encode()).hexdigest(), hit > 0] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    assert sum(r.contaminated for r in got) >= 6


def test_spans_are_cut_and_covered_documents_dropped(spark):
    docs = spark.createDataFrame([(1, "Aa bb, cc dd. Keep this and that too"), (2, "aa bb cc dd end"), (3, None)], "doc_id long, text string")
    parts = decontaminate.automata(spark.createDataFrame([(1, "aa BB cc dd")], "item_id long, text string"))
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, parts, max_coverage=0.5).collect()}
    assert got == {1: ". Keep this and that too", 3: None}


def test_language(spark, odd_docs):
    rows = [(k, " ".join(["der die und nicht ein"] * 9) if k % 2 else " ".join(["the and of that is"] * 9), "de" if k % 2 else "en") for k in range(20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(train)
    assert model[0] == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(train, model).collect()}
    assert all(got[k].lang_pred == lang and got[k].score > 0.9 for k, _, lang in rows)
    odd = langid.identify(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (5, 6, 7, 11)} == {"und"} and {r.score for r in odd if r.doc_id in (5, 6, 7, 11)} == {0.0}
    assert all(0 <= r.score <= 1 for r in odd)


def test_language_without_labels(odd_docs):
    model = langid.train(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(odd_docs, model).collect()} == {"und"}


def test_long_texts_are_read_whole(monkeypatch):
    """Cut anywhere, a text has the same n-grams, each as often."""
    odd = ["ab cd " * 100, "x   y" * 90, "é" * 300, "word ," * 60 + "  !?  " * 30 + "end", "a" + " " * 500 + "b", "no blanks" * 1 + "q" * 400]

    def grams():
        return [Counter(zip(*(np.concatenate(x).tolist() for x in zip(*langid.gram_cells([t]))))) for t in odd]

    whole = grams()
    for piece in (7, 50, 128):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert grams() == whole


def test_language_is_that_of_a_dense_naive_bayes(spark):
    """All grams counted in a dense matrix, uniform prior, half a gram added to each."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    names, matrix = langid.train(docs)
    rows = docs.collect()
    counts = np.zeros((langid.BUCKETS, len(names)))
    vectors = []
    for r in rows:
        v = np.zeros(langid.BUCKETS)
        for _, cells in langid.gram_cells([r.text]):
            np.add.at(v, cells, 1)
        vectors.append(v)
        if r.lang in names:
            counts[:, names.index(r.lang)] += v
    dense = np.log(counts + 0.5) - np.log((counts + 0.5).sum(axis=0))
    got = {r.doc_id: r for r in langid.identify(docs, (names, matrix)).collect()}
    agree = [got[r.doc_id].lang_pred == names[int((v @ dense).argmax())] for r, v in zip(rows, vectors) if v.any()]
    assert np.mean(agree) >= 0.99 and all(got[r.doc_id].lang_pred == langid.UNKNOWN for r, v in zip(rows, vectors) if not v.any())


def test_lines(spark):
    rows = [(k, "h1", f"menu\n  menu \nbody {k}\n\nfooter {k % 2}") for k in range(12)] + [(99, "h2", "menu\nx")] + [
        (100, None, "menu\nmenu"), (101, "h1", None), (None, "h1", ""), (102, "h1", "menu"), (102, "h1", "menu")]
    pages = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("lines", F.lit("clash"))
    got = line_dedup.drop_boilerplate(pages, "host", "text", 0.5, 10, n_lines="all_lines", n_dropped="dropped").collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[3].text == "body 3\n\nfooter 1" and by[3].dropped == 2 and by[3].all_lines == 4
    assert by[99].text == "menu\nx" and by[100].text == "menu\nmenu" and by[101].text is None and by[101].all_lines == 0
    assert by[None].text == "" and [r.text for r in got if r.page_id == 102] == ["", ""]
    assert line_dedup.drop_boilerplate(pages.where("false"), "host", "text").count() == 0


def test_copies_do_not_make_their_own_lines_boilerplate(spark):
    def words(seed, n):
        return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10_000, n))

    copied = f"{words(7, 40)}\n{words(8, 40)}\n\n{words(9, 40)}"
    rows = [(k, copied if k % 3 == 0 else f"menu\n{words(100 + k, 30)}") for k in range(90)]
    turned = "\n".join(reversed(copied.split("\n")))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in [*rows, (90, turned), (91, None), (92, "")]],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    lined = stages.line_dedup(spark, docs, "")
    got = {r.doc_id: r for r in lined.collect()}
    assert len(got) == 93 and all(got[k].text == copied and got[k].n_chars == len(copied) for k in range(0, 90, 3)) and got[90].text == turned
    assert all(got[k].text == words(100 + k, 30) for k in range(90) if k % 3) and got[91].text is None and got[92].text == ""
    once = {r.doc_id: r.text for r in stages.ngram_jaccard_join(spark, lined, "").collect()}
    assert sum(t in (copied, turned) for t in once.values()) == 1


def test_small_and_large_hosts_lose_lines_by_the_same_share(spark):
    sizes = {"tiny": 4, "small": 30, "large": 900}
    rows = [(h, f"{h} menu\nbody {k}\n" + (f"seldom {k % 11}" if k % 11 else "body")) for h, n in sizes.items() for k in range(n)]
    rows += [("one", "alone\nalone"), ("pair", "both\nfirst"), ("pair", "both\nsecond")]
    pages = spark.createDataFrame(rows, "host string, text string")
    got = line_dedup.drop_boilerplate(pages, "host", "text", 0.15, n_dropped="n").groupBy("host").agg(F.sum("n").alias("n"), F.collect_list("text").alias("t")).collect()
    by = {r.host: r for r in got}
    assert {h: by[h].n for h in by} == {**sizes, "one": 0, "pair": 2}
    assert by["one"].t == ["alone\nalone"] and sorted(by["pair"].t) == ["first", "second"]


@pytest.mark.parametrize("n_copies", [30, 200])
def test_near_copies_keep_what_they_share(spark, n_copies):
    def words(seed, n):
        return np.array([f"w{x}{'aegins'[x % 6]}" for x in np.random.default_rng(seed).integers(0, 5000, n)])

    def near(k, base):
        changed = base.copy()
        changed[np.random.default_rng(k).integers(0, len(base), 2)] = f"other{k}"
        return changed

    long, lined = words(1, 150), [words(s, 25) for s in range(2, 8)]
    texts = [f"the title\n{' '.join(near(k, long))}\nmenu" for k in range(n_copies)]
    texts += ["\n".join(" ".join(near(k, x) if j == k % 6 else x) for j, x in enumerate(lined)) for k in range(n_copies)]
    texts += [f"menu\n{' '.join(words(1000 + k, 40))}" for k in range(60)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lined_docs = stages.line_dedup(spark, docs, "")
    got = {r.doc_id: r.text for r in lined_docs.collect()}
    for k, t in enumerate(texts):
        assert got[k] == "\n".join(x for x in t.split("\n") if x != "menu")
    kept = stages.ngram_jaccard_join(spark, lined_docs, "").collect()
    assert sum(r.text.startswith("the title") for r in kept) < n_copies / 2 and sum(r.doc_id >= 2 * n_copies for r in kept) == 60


def test_stages_leave_other_columns_alone(spark):
    names = ["__row", "__stay", "__hits", "__site", "__often", "row", "given", "host", "site", "lines", "stay", "hits", "root"]
    texts = ["menu\none two three four five six", "menu\none two three four five six", "menu\nanother text with some words in it", None]
    rows = [(k, t, "en", "s", 0, *[f"{c}{k}" for c in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for out in (line_dedup.drop_boilerplate(docs, "source", "text"), stages.line_dedup(spark, docs, ""), ngram_join.keep_one(docs)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[c] for c in names] == [f"{c}{r.doc_id}" for c in names]


def test_page_text(spark):
    html = "<html><script>x<p></script><style>p{}</style><!-- <p>no --><P class='a'>One <b>two</b></p>three<br/>four</html>"
    got = spark.createDataFrame([(html, "HTTPS://A.b.c:80/x"), (None, "nowhere")], "html string, url string").select(
        line_dedup.html_text("html").alias("t"), line_dedup.url_host("url").alias("h")).collect()
    assert [x for x in got[0].t.split("\n") if x] == ["One two", "three", "four"] and got[0].h == "a.b.c"
    assert got[1].t is None and got[1].h is None


@pytest.fixture(scope="module")
def insults(spark):
    bad = ["idiot", "moron", "loser"]
    rows, labels = [], []
    rng = np.random.default_rng(5)
    for k in range(400):
        body = ["kind", "words", "here", "about", "nothing", "idle", "riot", "more", "lose"]
        toxic = k % 4 == 0
        text = list(rng.choice(body, 20)) + ([str(rng.choice(bad))] if toxic else [])
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 1), (None, 1), (5, None)], "doc_id long, toxic int")


def test_toxic_words_are_restored_and_scored(spark, insults, odd_docs):
    docs, labels = insults
    model = toxicity.language_model(docs)
    fitted = toxicity.train(docs.where("doc_id < 300"), labels, model)
    got = {r.doc_id: r for r in toxicity.score(docs, model, fitted).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(300, 400))
    hidden = spark.createDataFrame([(1, "you 1d10t here"), (2, "an i d i o t about"), (3, "m0r0000n words"), (4, "kind words"), (5, None), (6, "")], "doc_id long, text string")
    hid = {r.doc_id: r for r in toxicity.score(hidden, model, fitted).collect()}
    assert [hid[k].predicted for k in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 0, 0, 0]
    assert hid[4].score == hid[5].score == hid[6].score
    assert toxicity.score(odd_docs, model, fitted).count() == odd_docs.count()
    assert toxicity.Words(model).restored("The 1d10t, a l.o.s.e.r") == "the idiot a loser"


def test_heavy_disguises_are_restored(spark):
    texts = ["asshole ass stupid idiots stupididiots idiot tass"] * 50
    words = toxicity.Words(toxicity.language_model(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert [words.word(c) for c in ("455h013", "5tup1d1d10t5", "i" + "d" * 45 + "iot", "@$$", "i" + "d" * 100_000 + "iot")] == [
        "asshole", "stupididiots", "idiot", "ass", "idiot"]
    assert toxicity.disguised("5+4$") and words.spaced("an a s s here") == ["ass"] and words.spaced("an i  d  i  o  t") == ["idiot"]
    assert words.restored("rows 1 2 3") == "rows 1 2 3"
    plain = ["1944", "$1,234.50", "455", "10:30", "2024-01-02", "!!!", "$$$", "192.168.10.11", "http://a1b.c", "a1b2@mail8.example.com", "f47ac10b58cc4372a567", "q1" * 30]
    assert [c for c in plain if toxicity.disguised(c)] == []


def test_toxicity_without_labels(spark, insults):
    docs, labels = insults
    model = toxicity.language_model(docs.where("false"))
    fitted = toxicity.train(docs, labels.where("false"), model)
    assert {r.predicted for r in toxicity.score(docs, model, fitted).collect()} == {0}


def test_empty_tables(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert token_counts.count_tokens(no_docs).count() == 0
    assert packing.pack(packing.token_pieces(no_docs)).count() == 0
    assert ngram_join.near_duplicates(no_docs).count() == 0
    assert langid.identify(no_docs, langid.train(no_docs)).count() == 0
    items = no_docs.selectExpr("doc_id AS item_id", "text")
    assert decontaminate.contamination(no_docs, decontaminate.automata(items)).count() == 0


def test_words_are_runs_of_letters_and_digits():
    assert decontaminate.words_of("A-b É9_x".encode()) == [b"a", b"b", "É9".encode(), b"x"]
    assert re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "a-b É9_x".encode()) == decontaminate.words_of("A-b É9_x".encode())


def test_decoder_finds_the_best_of_all_readings():
    """Viterbi against all readings of short chunks, under a random letter model."""
    rng = np.random.default_rng(12)
    model = np.log(rng.dirichlet(np.full(28, 0.2), (28, 28, 28)) + 1e-6)
    decoder = toxicity.Decoder(model)

    def readings(word):
        """Every restored text with its best score."""
        found = {("", (0, 0, 0)): 0.0}
        before = ""
        for c in word:
            options = [(x, toxicity.DISGUISE) for x in toxicity.LOOKS.get(c, "")] + ([(c, 0.0)] if c.isalpha() else [])
            steps = {}
            for (path, last), score in found.items():
                ways = [("", toxicity.REPEAT if c == before else toxicity.LITERAL)] if c == before or not options else []
                for x, cost in [*ways, *options]:
                    k = (ord(x) - 96 if "a" <= x <= "z" else 27) if x else None
                    to = (path + x, (*last[1:], k) if x else last)
                    steps[to] = max(steps.get(to, -np.inf), score + cost + (model[(*last, k)] if x else 0.0))
            found, before = steps, c
        return {path: score + model[(*last, 0)] for (path, last), score in found.items()}

    for _ in range(200):
        word = "".join(rng.choice(list("abilost013457@$!|+2zé"), rng.integers(1, 7)))
        scores = readings(word.strip(toxicity._EDGE))
        assert abs(scores[decoder.restore(word)] - max(scores.values())) < 1e-6


def test_scores_are_those_of_the_fitted_weights(spark):
    """A logistic score computed by hand from each text's features."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.language_model(docs)
    chosen, weights, bias = trained = toxicity.train(docs, labels, model)
    features = toxicity.Features(model, chosen)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, trained).collect()}
    for r in docs.collect():
        total = bias + sum(weights[k] for k in features.of(r.text))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-6
