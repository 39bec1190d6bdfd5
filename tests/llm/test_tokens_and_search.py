"""Byte-level BPE, fill-in-middle and lexical search against the library, plain definitions and odd rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tickloom.llm import byte_bpe, fill_middle, lexical_search, queries

PATH = public_tokenizers.path(byte_bpe.VOCABULARY)
with open(PATH, "rb") as _lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _lines)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(PATH)


def encoded(encoder, text):
    return [k for ids in encoder.encode(text) for k in ids.tolist()]


def odd_texts():
    rng = random.Random(4)
    marks = [32, 10, 9, 39, 115, 97, 98, 0x20AC, 0x4E2D, 0x1F600, 0x300, 0x558, 0x1C89, 0x11DE0, 0x2028, 0x85, 0xA0, 0x1C, 48, 0xBD, 0x10D40, 0x3134A, 0]
    texts = ["".join(chr(rng.choice(marks)) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["".join(chr(rng.choice(range(0xD7FF))) for _ in range(40)) for _ in range(100)]
    return texts + ["", "a" * 5000, "ab" * 2000, " " * 999 + "x", "\n" * 999, "x " * 999, "don't I'll we've", "<|endoftext|>"]


def test_ids_are_those_of_the_library(encoder):
    for text in odd_texts():
        assert encoded(encoder, text) == LIBRARY.encode_ordinary(text), ascii(text)


def test_stretches_do_not_change_the_ids(encoder, monkeypatch):
    text = "some  words \n and more\t\twords, " * 40
    want = LIBRARY.encode_ordinary(text)
    for chunk in (1, 7, 100):
        monkeypatch.setattr(byte_bpe, "CHUNK", chunk)
        assert encoded(encoder, text) == want


def test_few_states_are_enough_and_ids_come_early():
    small = byte_bpe.Transducer(byte_bpe.Vocabulary(PATH), max_states=50)
    rng = random.Random(5)
    for _ in range(50):
        piece = "".join(rng.choice("thequickbrown") for _ in range(60)).encode()
        assert small.ids(piece) == LIBRARY._encode_single_piece(piece)
    assert len(small.states) <= 51
    piece = "".join(rng.choice("thequickbrown") for _ in range(20_000)).encode()
    assert small.ids(piece) == LIBRARY._encode_single_piece(piece)
    assert 0 < small.longest_wait <= max(map(len, RANKS))


def test_one_step_a_byte_on_a_long_piece():
    made = byte_bpe.Transducer(byte_bpe.Vocabulary(PATH))
    made.ids(b"ab" * 500)
    states = len(made.states)
    assert made.ids(b"ab" * 50_000) == LIBRARY._encode_single_piece(b"ab" * 50_000)
    assert len(made.states) == states


def test_decoder_holds_back_incomplete_characters(encoder):
    rng, decoder = random.Random(6), byte_bpe.StreamDecoder(encoder.words)
    for text in odd_texts():
        ids, said, raw = LIBRARY.encode_ordinary(text), [], []
        while ids:
            n = rng.randint(1, 5)
            data, chars = decoder.feed(np.array(ids[:n], np.int64))
            raw.append(data)
            said.append(chars)
            ids = ids[n:]
        assert "".join(said) + decoder.finish() == text and b"".join(raw) == text.encode()
    singles = [RANKS[bytes([b])] for b in range(256)]
    for _ in range(3000):
        ids = np.array([rng.choice(singles) for _ in range(rng.randint(1, 8))])
        data, chars = decoder.feed(ids)
        assert chars + decoder.finish() == data.decode("utf-8", "replace")


def test_texts_are_encoded_and_decoded(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = Counter()
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), len(t or "")] += 1
    assert Counter(map(tuple, byte_bpe.round_trip(odd_docs).collect())) == want
    tokens = byte_bpe.encode(odd_docs, keep=("doc_id", "row", "k0"))
    assert tokens.columns == ["doc_id", "row", "k0", "ids"]
    back = byte_bpe.decode(tokens, keep=("doc_id", "k0"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert byte_bpe.decode(byte_bpe.encode(no_docs)).count() == byte_bpe.round_trip(no_docs).count() == 0


def test_bytes_that_are_no_text(spark):
    frame = spark.sql("select 1 as doc_id, cast(X'61FF62E282' as string) as text")
    assert byte_bpe.decode(byte_bpe.encode(frame)).first().text == "a�b�"
    assert fill_middle.transform(frame, rate=0).select(F.hex("output").alias("h")).first().h == "61FF62E282"


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut(name, text, unit, rate=50, seed=42):
    """By the definition: form, units, parts."""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def cut_docs(spark):
    rng = random.Random(7)
    alphabet = list("ab  \t\n<>PSM") + ["é", "中", "😀", "\x1c", "\x85", " ", "\0"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))), "x", 1) for i in range(300)]
    rows += [(i, None, "x", 1) for i in (301, None)]
    rows += [(None, "a null id", "x", 1), (7, "again 7", "x", 1), (7, "again 7", "x", 1), (400, "<P> holds a sentinel", "x", 1), (401, " ", "x", 1),
             (402, "word " * 5000 + "é", "x", 1), (403, "é" * 5000, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, k0 int")


@pytest.mark.parametrize("unit", ["token", "char"])
@pytest.mark.parametrize("rate", [50, 100])
def test_texts_are_cut_in_three(cut_docs, unit, rate):
    out = fill_middle.transform(cut_docs, unit=unit, rate=rate).withColumn("again", fill_middle.restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    rows = cut_docs.select("doc_id", "text").collect()
    assert Counter(map(tuple, out.collect())) == Counter((i, *cut(i, t or "", unit, rate), t or "") for i, t in rows)
    forms = Counter(r.form for r in out.collect())
    assert min(forms["psm"], forms["spm"]) > 10


def test_cutting_odd_rows(odd_docs, no_docs):
    out = fill_middle.transform(odd_docs, keep=("k0", "row"))
    assert out.columns[:3] == ["doc_id", "k0", "row"]
    assert Counter((r.doc_id, r.n, r.form, r.output) for r in out.collect()) == Counter(
        (i, *[cut(i, t or "", "token")[k] for k in (0, 1, 4)]) for i, t in odd_docs.select("doc_id", "text").collect())
    assert fill_middle.transform(no_docs).count() == 0
    with pytest.raises(ValueError):
        fill_middle.transform(no_docs, unit="word")


def test_exceptions_convert_both_ways():
    text = "aé中b😀" * 50 + "plain" * 20 + "ü"
    index = fill_middle.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    points = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in points])
    assert (index.to_bytes(points) == places).all() and (index.to_points(places) == points).all()
    assert len(index.byte) == sum(ord(c) > 127 for c in text)
    assert len(fill_middle.ExceptionIndex(np.frombuffer(b"plain", np.uint8)).byte) == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x.group().lower(), text or ""))


def best_documents(items, docs, best=10):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for q, text in items:
        scored = []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(q, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:best], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark, odd_docs):
    base = [r.text for r in odd_docs.where("doc_id = 1").collect()][0].split()
    rows = [(1, " ".join(base[:30])), (2, "one ONE two"), (3, None), (4, " ?! "), (5, "nowhere"), (6, "Été été ünder İstanbul"), (2, "one ONE two"),
            (None, " ".join(base[50:60])), (7, "x" * 3000), (8, "123 zero\0one")]
    return spark.createDataFrame([(*r, 0) for r in rows], "item_id int, text string, score int")


@pytest.mark.parametrize("stretch", [1, 9, 100, 1 << 20])
def test_terms_are_counted_whole(monkeypatch, stretch):
    """Frequencies of the items' terms in texts that are scanned in stretches of any length."""
    monkeypatch.setattr(lexical_search, "_SLICE", stretch)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aab  -É1") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", "a", " a", "a ", "a a  a"]
    asked = lexical_search.Queries([(1, "a aa b ab É1".encode()), (2, "b 1 a".encode()), (3, b"")])
    n, text, term, tf = lexical_search.Scanner(asked).count([t.encode() for t in texts])
    assert n.tolist() == [len(terms(t)) for t in texts]
    found = {(int(i), asked.terms[k].decode()): int(f) for i, k, f in zip(text, term, tf)}
    known = {t.decode() for t in asked.terms}
    assert found == {(i, w): f for i, t in enumerate(texts) for w, f in Counter(terms(t)).items() if w in known}


def test_lists_are_kept_whatever_the_steps():
    """The running lists against a sort of all scores, with many ties, in steps of any size."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    scores = rng.integers(0, 4, (500, 7))
    ids = rng.permutation(500)
    for step in (1, 3, 64, 500):
        lists = lexical_search.BestDocuments(7, 10, pa.int64())
        for lo in range(0, 500, step):
            lists.add(scores[lo: lo + step], pa.array(ids[lo: lo + step]))
        got = sorted(zip(*[lists.table[c].to_pylist() for c in ("q", "score", "doc")]), key=lambda r: (r[0], -r[1], r[2]))
        want = [(q, int(scores[i, q]), int(ids[i])) for q in range(7)
                for i in sorted((i for i in range(500) if scores[i, q] > 0), key=lambda i: (-scores[i, q], ids[i]))[:10]]
        assert got == want


@pytest.mark.parametrize("options", [{}, {"block_bytes": 60}, {"best": 2}])
def test_best_documents(items, odd_docs, options):
    got = lexical_search.search(items, odd_docs, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = best_documents([tuple(r)[:2] for r in items.collect()], [tuple(r) for r in odd_docs.select("doc_id", "text").collect()], options.get("best", 10))
    assert Counter(map(tuple, got.collect())) == want and len(want) > 10


def test_many_equal_scores_rank_by_id(spark, items):
    docs = spark.range(3000).select((3000 - F.col("id")).cast("string").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one word here").otherwise("Two ONE").alias("text"))
    docs = docs.repartition(5)
    got = lexical_search.search(items.where("item_id = 2").limit(1), docs)
    assert Counter(map(tuple, got.collect())) == best_documents([(2, "one ONE two")], [tuple(r) for r in docs.collect()])


def test_nothing_to_search(items, odd_docs, no_docs):
    assert lexical_search.search(items, no_docs).count() == 0
    empty = lexical_search.search(items.where("item_id in (3, 4)"), odd_docs)
    assert empty.count() == 0 and dict(empty.dtypes) == dict(lexical_search.search(items, odd_docs).dtypes)


def test_query_ranks_every_item(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.queries()["op13_lexical_search"](spark, sf).collect()
    want = best_documents([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()],
                          [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    assert Counter(map(tuple, got)) == want


def test_query_encodes_as_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.queries()["op11_byte_bpe"](spark, sf).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))
