"""Texts with very many matches, lines without an end, and the places that native expressions give."""

import itertools
import random
import time

from pyspark.sql import functions as F

import public_tokenizers
from tokenizers import Tokenizer

from tallyweave.llm import cutting, levenshtein, personal_data, secret_scan, token_counts, toxicity

DOCS = "doc_id long, text string"


def test_scanned(spark):
    for n in (0, 1, 64, 65, 4097, 20_000):
        values = [k * 7919 % 1013 for k in range(n)]
        row = spark.createDataFrame([(values,)], "a array<long>").select(cutting.scanned(F.col("a"), lambda x, y: x + y).alias("sum"), cutting.scanned(F.col("a"), lambda x, y: F.greatest(x, y)).alias("top")).first()
        assert row["sum"] == list(itertools.accumulate(values)) and row["top"] == list(itertools.accumulate(values, max))


def test_between(spark):
    text = "".join(chr(97 + k % 26) if k % 5 else "é😀"[k % 2] for k in range(3 * cutting.PIECE + 17))
    places = [(a, b) for a in (0, 1, cutting.PIECE - 1, cutting.PIECE, 2 * cutting.PIECE + 3) for b in (0, a, a + 1, a + 300, len(text), len(text) + 9)]
    df = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a long, b long")
    for r in df.select("a", "b", cutting.between(cutting.pieces(F.col("t")), F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == (text[r.a : r.b] if r.b > r.a else "")


def test_many_matches_of_personal_data(spark):
    n = 150_000
    text = " ".join(f"{k}@a.bc" for k in range(n)) + " and 12 numbers " + "7 " * n + "DE89 3704 0044 0532 0130 00 é"
    began = time.time()
    df = spark.createDataFrame([(1, text)], DOCS)
    assert personal_data.personal_spans(df).select(F.size("spans")).first()[0] == n + 1
    assert personal_data.masked(df).first().text == "[email] " * n + "and 12 numbers " + "7 " * n + "[iban] é"
    assert time.time() - began < 120


def test_context_moves_scores(spark):
    told = {1: "call +1 555 123 4567 now", 2: "order +1 555 123 4567 now", 3: "+1 555 123 4567, my fax", 4: "+1 555 123 4567", 5: "part DE89370400440532013000", 6: "xDE89370400440532013000", 7: "my ssn 123-45-6789", 8: "123-45-6789"}
    df = spark.createDataFrame(list(told.items()), DOCS)
    found = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.spans] for r in personal_data.personal_spans(df).collect()}
    assert found == {1: [("phone", 0.9)], 2: [("phone", 0.4)], 3: [("phone", 0.9)], 4: [("phone", 0.6)], 5: [], 6: [], 7: [("ssn", 0.6)], 8: []}


def test_masking_leaves_nothing_of_spans_that_overlap(spark):
    # The card ends inside the address, which goes on behind it.
    text = "pay 4111 1111 1111 1111@a.bc today"
    assert personal_data.masked(spark.createDataFrame([(1, text)], DOCS)).first().text == "pay [card] today"


def test_quotes_as_lines_tell_them():
    rng = random.Random(2)

    def plainly(text, start, end):
        line, rest = text[text.rfind("\n", 0, start) + 1 : start], text[end : (text.find("\n", end) + 1 or len(text) + 1) - 1]
        return any((line.count(a) % 2 == 1 if a == b else line.rfind(a) > line.rfind(b)) and b in rest for a, b in toxicity.QUOTES.items())

    for _ in range(400):
        text = "".join(rng.choice('ab c\n"“”„«»‘’') for _ in range(rng.randint(1, 60)))
        marks = toxicity.Marks(text)
        for m in toxicity.WORDS.finditer(text):
            assert marks.quoted(*m.span()) == plainly(text, *m.span()), text


def test_a_long_line_of_hits():
    words = toxicity.Words(toxicity.Model((), toxicity.SEEDS, frozenset(), frozenset(), tuple(toxicity.PRIOR)))
    began = time.time()
    _, n, aside = toxicity.features('"' + "idiot " * 300_000 + '"', words)
    assert (n, aside) == (300_000, 300_000) and time.time() - began < 20


def test_kept_states_are_bounded(monkeypatch):
    monkeypatch.setattr(levenshtein, "MOST_PAIRS", 500)
    lexicon, other = levenshtein.Lexicon((), toxicity.SEEDS), levenshtein.Lexicon((), toxicity.SEEDS)
    rng = random.Random(1)
    for _ in range(3000):
        w = "".join(rng.choice("idotscumlerap") for _ in range(rng.randint(2, 9)))
        other._forget()
        assert lexicon.match(w) == other.match(w)
    assert lexicon.held < 3000
    assert levenshtein.Lexicon((), ("idiot", "worthless")).near("idiots") == [("idiot", 1)]


def test_runs_are_read_once_by_every_rule():
    began = time.time()
    for unit in ("eyJ", "-----BEGIN A", "ghp_", "password  ", "AKIA", "a1"):
        text = unit * (3_000_000 // len(unit))
        for rule in secret_scan.BASE + secret_scan.MORE:
            secret_scan.matches(rule, secret_scan.compiled(rule), text)
    assert time.time() - began < 60
    told = "x eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM-y xeyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM"
    assert [m for r in secret_scan.MORE for m in secret_scan.matches(r, secret_scan.compiled(r), told)] == [(2, 40)]


def test_both_tiers_answer_all_texts(monkeypatch):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    table = token_counts.frequent_lengths(tokenizer)
    assert table.get("the") == 1 and table.get("no such word") is None and len(table.lengths) > 20_000
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 4000)
    counter = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"), table)
    asked = []
    tokenize = tokenizer.model.tokenize
    for lengths in (counter.lengths, counter.seen):
        lengths.model = type("Model", (), {"tokenize": staticmethod(lambda x: asked.append(x) or tokenize(x))})
    for text in ("the cat — the “cat” sat", "the cat sat", "日本 the cat 😀 zqxj zqxj", " ".join(f"w{k}" for k in range(300))):
        assert counter(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert "the" not in asked and asked.count("zqxj") == 1 and counter.lengths.held <= 4000
