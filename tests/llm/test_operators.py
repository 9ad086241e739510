"""The ten operators against plain versions, and on null, empty, long, tied, repeated and clashing rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import (
    decontamination,
    embedding_links,
    fm_index,
    groups,
    levenshtein,
    lm_scores,
    packing,
    personal_data,
    secret_scan,
    shards,
    token_counts,
    toxicity,
    trigrams,
    weighted_minhash,
    words,
)

ODD = ["", None, "a", "  \n\t ", "!!!", "Éé ß 日本 😀 ǅ", "x" * 70_000, "a b c " * 5000, "<|endoftext|> x", "same text of some words here", "same text of some words here"]
#: Names that the operators use themselves.
CLASHING = "doc_id long, text string, id string, spans string, band long, row int, score string, part string, size string"


@pytest.fixture
def odd(spark):
    rows = [(k, t, "i", "s", 1, None, "z", None, "q") for k, t in enumerate(ODD)] + [(None, "same text of some words here", None, None, None, None, None, None, None), (3, "  \n\t ", "i", "s", 1, None, "z", None, "q")]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def texts(seed, n=60, longest=200):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "blå", "x1", "日本"] + ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    return [rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def test_words():
    for t in [x or "" for x in ODD] + texts(1):
        data = np.frombuffer((t + t).encode(), np.uint8)
        half = len(t.encode())
        folded, b, e, heads = words.spans(data, np.array([0, half, 2 * half]))
        told = [bytes(folded[i:j]).decode() for i, j in zip(b, e, strict=True)]
        assert told == words.of_text(t) * 2 and heads.tolist() == [0, len(b) // 2, len(b)]
        h = words.hashes(folded, b, e)
        assert len(set(h.tolist())) == len(set(told))
        kept, words.TOGETHER = words.TOGETHER, 64
        assert (words.hashes(folded, b, e) == h).all()
        words.TOGETHER = kept


def test_groups(spark):
    df = spark.range(1000).selectExpr("id % 7 AS a", "id % 3 AS b", "id")
    import pyarrow as pa

    out = groups.by_group(df, ["a", "b"], "a long, n long", lambda t: pa.RecordBatch.from_arrays([t["a"][:1].combine_chunks(), pa.array([t.num_rows])], ["a", "n"])).collect()
    assert len(out) == 21 and sum(r.n for r in out) == 1000


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


@pytest.mark.parametrize("term", ["idiot", "worthless", "clown"])
def test_automaton(term):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _step(row, x, b, i)
        return row[-1]

    def _step(row, x, b, i):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    lexicon, rng = levenshtein.Lexicon((), ("idiot", "worthless", "clown", "scum")), random.Random(term)
    for _ in range(400):
        w = list(term)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "i", "s"])
        w = "".join(w)
        best = min(((d, t) for t in ("idiot", "worthless", "clown", "scum") if (d := distance(w, t)) <= levenshtein.allowed(t)), default=None)
        assert lexicon.match(w) == (None if best is None else ("term", best[0])), w


def test_toxicity(spark, odd, none):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioutnrk") for _ in range(6)) for _ in range(3000)]
    plain = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 60))) for _ in range(300)]
    toxic = rng.sample(range(300), 100)
    for k in toxic:
        plain[k] += f" you {rng.choice(['blorgle', 'snarfed', 'idiot'])} " + plain[k][:20]
    docs = table(spark, plain)
    labels = spark.createDataFrame([(k, int(k in toxic)) for k in range(300)] + [(None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert {"blorgle", "snarfed", "idiot"} <= set(model.terms)
    found = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert {k for k, s in found.items() if s >= 0.5} == set(toxic) and all(0 <= s <= 1 for s in found.values())
    more = table(spark, ["you are a snarfedd one", "you are a id10t", "the word idiot is a noun", 'he wrote "idiot" once', "nothing here"])
    by = [r.score for r in toxicity.scored(more, model).orderBy("doc_id").collect()]
    assert by[0] > 0.5 and by[1] > 0.5 and by[4] < 0.5 and by[3] < by[0] and by[2] < by[0]
    assert toxicity.scored(odd, model).where("score BETWEEN 0 AND 1").count() == odd.count()
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    empty = toxicity.fitted(none, labels.limit(0))
    assert empty.terms == toxicity.SEEDS and toxicity.scored(none, empty).count() == 0


# 2


def test_tokens(spark, odd, none):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = token_counts.token_counts(odd).collect()
    assert len(found) == odd.count()
    for r in found:
        t = (ODD[r.doc_id] if r.doc_id is not None else ODD[9]) or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) and r.over_limit == (r.n_tokens > 2048)
    rng = random.Random(2)
    letters = "aAbBéÉİıſΣσς ẞß́​  'sdt<|>_1२½Ⅷ日本𝔸😀\t\n~-’ǅͅ\x1c\x85\xa0"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    counter = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    assert [counter(t) for t in made] == [len(library.encode(t, add_special_tokens=False).ids) for t in made]
    assert token_counts.token_counts(none).count() == 0


# 3


def test_links(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((40, 16))
    vectors = np.concatenate([centre, centre[:20] + 0.06 * rng.standard_normal((20, 16)), centre[:3] + 0.1 * rng.standard_normal((3, 16)), centre[[1] * 5]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    label = groups.joined(close)
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, vectors[0].tolist())]
    found = embedding_links.linked(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    by = {r.vec_id: r for r in found}
    assert len(found) == len(rows) + len(odd)
    assert [by[k].n_links for k in range(len(rows))] == close.sum(1).tolist()
    assert [by[k].component_id for k in range(len(rows))] == label.tolist()
    assert all(by[k].n_links == 0 and by[k].kept for k in range(900, 905)) and by[905].n_links == by[906].n_links == 1 and not by[906].kept
    assert embedding_links.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_links_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(embedding_links, "CHUNK", 7)
    rng = np.random.default_rng(2)
    v = (np.ones(8) + 0.02 * rng.standard_normal((40, 8))).astype(np.float32)
    found = embedding_links.linked(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()
    assert {r.n_links for r in found} == {39} and {r.component_id for r in found} == {0}


# 4


def plain_spans(text):
    import re

    text, out = text or "", []
    for k, kind in enumerate(personal_data.KINDS):
        p = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+"}.get(kind.name, kind.pattern)
        for m in re.finditer(p, text):
            v, good = m.group(), True
            digits = [int(c) for c in v if c in "0123456789"]
            if kind.name == "ip":
                good = all(int(x) <= 255 for x in v.split("."))
            elif kind.name == "card":
                good = 16 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
            elif kind.name == "phone":
                good = 8 <= len(digits) <= 15
            elif kind.name == "iban":
                good = len(v) == personal_data.IBAN_LENGTHS.get(v[:2]) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
            elif kind.name == "ssn":
                good = False
            if good:
                out.append((k, m.start(), m.end()))
    return out


def test_personal_data(spark, odd, none):
    rng = random.Random(4)
    bits = ["a@b.cc", "x.y+z@q-r.example.org", "@", ".", "_d@e.ff", "1.2.3.4", "300.1.1.1", "0001.2.3.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+123", "+44 20 7946 0958.", "DE89370400440532013000", "DE89370400440532013001", " ", " ", "word", "é", "😀", "12", "-"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["1" * 30_000, "1 " * 20_000, "a" * 50_000 + "@", "+" + "1" * 20_000, None, ""]
    found = {r.doc_id: [([k.name for k in personal_data.KINDS].index(s.kind), s.start, s.end) for s in r.spans] for r in personal_data.personal_spans(table(spark, made)).collect()}
    assert found == {k: plain_spans(t) for k, t in enumerate(made)}
    row = personal_data.personal_spans(table(spark, ["his SSN 123-45-6789", "part 123-45-6789"])).orderBy("doc_id").collect()
    assert [len(r.spans) for r in row] == [1, 0] and row[0].spans[0].kind == "ssn"
    hidden = {r.doc_id: r.text for r in personal_data.masked(table(spark, ["é a@b.cc, 4111 1111 1111 1111!", "clean", None])).collect()}
    assert hidden == {0: "é [email], [card]!", 1: "clean", 2: None}
    assert personal_data.personal_spans(none).count() == 0
    assert personal_data.personal_spans(odd).count() == personal_data.masked(odd).count() == odd.count() and personal_data.masked(odd).columns == odd.columns


# 5


def brute_classes(rows, least=0.8):
    """Classes by all pairs, with weights from exact frequencies above the floor."""
    import pyarrow as pa

    from tallyweave.llm.common import text_bytes

    ids, times, heads = weighted_minhash.shingles(*text_bytes(pa.array([t or "" for t in rows])))
    n = sum(t is not None for t in rows)
    floor = max(1.0, weighted_minhash.FLOOR * n)
    names, counts = np.unique(ids, return_counts=True)
    idf = dict(zip(names.tolist(), (1 + np.log(n / np.maximum(counts, floor))).tolist(), strict=True))
    group = weighted_minhash.Group([ids[a:b] for a, b in zip(heads, heads[1:], strict=False)], [np.array([idf[i] * k for i, k in zip(ids[a:b].tolist(), times[a:b].tolist(), strict=True)]) for a, b in zip(heads, heads[1:], strict=False)])
    first = {}
    for i, t in enumerate(rows):
        if t is not None and t in first:
            group.link(first[t], np.array([i]))
        elif t is not None:
            first[t] = i
    for i in range(len(rows)):
        others = np.array([j for j in range(i + 1, len(rows)) if len(group.ids[j]) and len(group.ids[i])], int)
        if len(others) and len(found := group.similar(i, others, least)):
            group.link(i, found)
    return group.root.tolist()


def near_copies(seed):
    rng, rows = random.Random(seed), texts(seed, 40, 150)
    for k in range(25):
        w = rng.choice(rows[:10]).split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append(" ".join(w))
    return rows + [rows[0], None, "", "", "!!!", "one two", "One two!", None]


@pytest.mark.parametrize("chunk", [1000, 4])
def test_near_duplicates(spark, chunk):
    rows = near_copies(11)
    found = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(table(spark, rows), chunk=chunk).collect()}
    assert found == dict(enumerate(brute_classes(rows)))


def test_near_duplicates_odd(spark, odd, none):
    found = weighted_minhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert by[10].class_id == 9 and by[None].kept and by[1].class_id == 1 and by[0].class_id == 0
    kept = weighted_minhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert weighted_minhash.near_duplicates(none).count() == 0


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    ids = np.sort(rng.integers(0, 2**32, 3000, dtype=np.uint64)).astype(np.uint32)
    w = rng.uniform(1, 3, 3000)
    a, b = np.arange(3000) < 2500, np.arange(3000) >= 300
    true = np.minimum(w * a, w * b).sum() / np.maximum(w * a, w * b).sum()
    agree = [(lambda s: (s[0] == s[1]).mean())(weighted_minhash.samples(np.concatenate([ids[a] ^ np.uint32(k), ids[b] ^ np.uint32(k)]), np.concatenate([w[a], w[b]]), np.array([0, a.sum(), a.sum() + b.sum()]))) for k in range(1, 40)]
    assert abs(np.mean(agree) - true) < 0.05


# 6


def test_fm_index():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (50, 2), (400, 3), (1500, 9)):
        text = rng.integers(0, k + 1, n)
        text[-1] = 0
        text[n // 2 : n // 2 + n // 5] = text[: n // 5]
        index = fm_index.FMIndex(text, k)
        phrases = np.zeros((30, 4), np.int64)
        lengths = rng.integers(1, 5, 30)
        for i in range(30):
            phrases[i, : lengths[i]] = rng.integers(1, k + 1, lengths[i])
        low, high = index.search(phrases.ravel(), np.arange(30) * 4, lengths, 7)
        for i in range(30):
            want = [p for p in range(n - lengths[i] + 1) if (text[p : p + lengths[i]] == phrases[i, : lengths[i]]).all()]
            assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want


def test_decontamination(spark, odd, none, monkeypatch):
    rng = random.Random(6)
    source = texts(8, 20, 80)
    items = [(f"i{k}", " ".join(words.of_text(rng.choice(source)))[rng.randint(0, 9) :]) for k in range(12)] + [("short", "the of"), ("null", None), ("none", "..."), ("i0", None)]
    rows = source + [s.upper() + " " + rng.choice(source) for s in source] + [t for t in ODD]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    want = decontamination.brute(list(enumerate(rows)), items)

    def told(docs):
        found = decontamination.removal_spans(docs, benchmark)
        return sorted(map(tuple, found.select("doc_id", "n_words", decontamination.words_in("spans", "text"), F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.size("spans") > 0).collect()))

    docs = table(spark, rows)
    assert told(docs) == want
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    assert told(docs) == want
    clean = {r.doc_id: r.text for r in decontamination.decontaminated(docs, benchmark).collect()}
    assert all(clean[d] == rows[d] for d, *_, hit in want if not hit) and all(len(clean[d]) < len(rows[d]) for d, *_, hit in want if hit)
    assert decontamination.decontaminated(odd, benchmark).columns == odd.columns
    assert decontamination.removal_spans(none, benchmark).count() == 0
    assert decontamination.removal_spans(docs, benchmark.limit(0)).where("size(spans) > 0").count() == 0


# 7


@pytest.mark.parametrize("window", [1, 7, 64])
def test_best_fit(window):
    lengths = np.sort(np.random.default_rng(window).integers(1, window + 1, 300))[::-1]
    at, offset = packing.best_fit(lengths, window)
    left = []
    for n, o in zip(lengths.tolist(), offset.tolist(), strict=True):
        fits = [c for c in left if c >= n]
        capacity = min(fits) if fits else window
        if fits:
            left.remove(capacity)
        assert window - o == capacity
        left.append(capacity - n)
    assert len(set(at.tolist())) == len(left)


def test_packing(spark, odd, none):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.packed(odd).collect()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(ODD)} | {None: library.encode(ODD[9], add_special_tokens=False).ids + [1]}
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length and len(ids[r.doc_id]) == r.doc_tokens
    assert sum(r.length for r in found) == sum(map(len, ids.values())) + len(ids[3])
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist() and sum(n for _, n in s) <= 2048
    assert packing.packed(none).count() == 0
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts(9, 30) + [t or "" for t in ODD]:
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


# 8


def brute_scores(rows):
    import math
    from collections import Counter

    told = [words.of_text(t) for t in rows]
    one, two = Counter(w for d in told for w in d), Counter(p for d in told for p in zip(d, d[1:], strict=False))
    micro = lambda n: int(np.rint(math.log(n) * 1e6))
    return [None if not d else micro(one[d[0]]) - micro(sum(one.values())) + sum(micro(two[p]) - micro(one[p[0]]) for p in zip(d, d[1:], strict=False)) for d in told]


def test_backoff(spark):
    counts = lm_scores.ngram_counts(table(spark, ["a b a b c"]), 2)
    assert {(r.n, r.gram): r["count"] for r in counts.collect()} == {(1, "a"): 2, (1, "b"): 2, (1, "c"): 1, (2, "a b"): 2, (2, "b a"): 1, (2, "b c"): 1}
    found = {r.doc_id: r.score for r in lm_scores.score_against(table(spark, ["a b", "c a", "z", "", None]), counts).collect()}
    log = np.log
    assert np.allclose([found[0], found[1], found[2]], [(log(2 / 5) + log(2 / 2)) / 2, (log(1 / 5) + log(0.4) + log(2 / 5)) / 2, log(0.5 / 5)]) and found[3] is None and found[4] is None
    # Scored by its own counts a corpus needs no backoff, and both ways agree.
    docs = table(spark, texts(13, 20, 30))
    plain = brute_scores([r.text for r in docs.orderBy("doc_id").collect()])
    own = {k: None if x is None else x / 1e6 / len(words.of_text(t)) for k, (x, t) in enumerate(zip(plain, [r.text for r in docs.orderBy("doc_id").collect()], strict=True))}
    other = {r.doc_id: r.score for r in lm_scores.score_against(docs, lm_scores.ngram_counts(docs)).collect()}
    assert all((own[k] is None) == (other[k] is None) and (own[k] is None or abs(own[k] - other[k]) < 1e-5) for k in own)


# 9


def test_shards(spark, odd, none):
    rows = texts(14, 400) + ["hot text " * 20] * 300 + [None, ""]
    found = shards.sharded(table(spark, rows), 8).collect()
    assert len(found) == len(rows)
    sizes = [len((t or "").encode()) + 1 for t in rows]
    totals, slots = [0] * 8, [[] for _ in range(8)]
    for r in found:
        assert r.size == sizes[r.doc_id] and r.text_crc32 == zlib.crc32((rows[r.doc_id] or "").encode())
        totals[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(totals) - min(totals) <= 2 * max(sizes) and all(sorted(s) == list(range(len(s))) for s in slots)
    assert shards.sharded(odd).count() == odd.count() and shards.sharded(none).count() == 0


# 10


def test_trigram_queries():
    assert trigrams.of_pattern("[0-9a-f]+") is True and trigrams.of_pattern("a.c") is True
    assert trigrams.of_pattern("abcd[0-9]+wxyz") == ("and", ["abc", "bcd", "wxy", "xyz"])
    assert trigrams.of_pattern("(?i:(foo|bar))x?") == ("or", ["bar", "foo"]) or "foo" in trigrams.of_query(trigrams.of_pattern("(?i:(foo|bar))x?"))
    assert trigrams.of_pattern("(abc)*def") == "def"


def test_secrets(spark, odd, none):
    rng = random.Random(15)
    bits = ["password", "PASSWORD", "token", "apikey", "api_key", "AKIA", "ABCDEF0123456789", "=", ": ", '"', "'", " ", "abc", "secret", "ſecret", "deadbeef" * 3, "deadbeef", "é", "😀", "x.y/z", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 12, "\n"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ODD
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.secret_spans(table(spark, made)).collect()}
    for k, t in enumerate(made):
        counts, digest, told = secret_scan.brute(t)
        assert ",".join(f"{a}:{b}:{c}" for a, b, c in found[k]) == told
        assert hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in found[k] if a in ("assign", "access", "hex")).encode()).hexdigest() == digest
    assert secret_scan.secret_spans(odd).count() == odd.count() and secret_scan.secret_spans(none).count() == 0
