"""The language-model operators against brute force, exact round trips and held-out labels."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as e
from gleanery.llm import cws, minhash, mixing, presplit, quality_llr, rangecoder, secrets, sharding, token_counts, toxicity_mil
from gleanery.llm import queries as llm
from gleanery.llm.bpe_automaton import Codec, compile_merges, encode_texts
from gleanery.llm.bpe_automaton import digests as bpe_digests

WORD = re.compile(r"[^ \t-\r]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéABß漢") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


def fixture():
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(0, 120)) for _ in range(40)]
    base = prose(rng, 200).split(" ")
    for k in range(12):  # a group of near copies, and exact ones
        near = list(base)
        for _ in range(k // 2):
            near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [texts[0]] * 5 + ["", None, "   \n\t", "one", "one two", "one two three", "x" * 30_000, "a b " * 8_000, "\x85 \xa0 y", "tie tie tie tie tie"]
    texts += [f"the {k}\npassword = \"abc{k}defg\" secret=token: pass AKIA{'A1' * 9} {'0f' * 13}" for k in range(3)]
    texts += ["tokens=short passwd:x api-key=nope API_KEY: Zz9/+=.-_ token=secret=token: abcdefgh", "<|endoftext|> a<|endoftext|>", "-----BEGIN RSA PRIVATE KEY-----"]
    return [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]


ROWS = fixture()
TEXT = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 7 == 0)) for i in range(0, len(ROWS), 2)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def odd(spark):
    """Clashing column names, repeated rows and a null id."""
    rows = [(None, "a b c d e f", 1, "x"), (5, "a b c d e f", 1, "x"), (5, "a b c d e f", 1, "x"), (6, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept int, _quality string").withColumn("n", F.lit(1)).withColumn("rep", F.lit(2)).withColumn("g", F.lit(3)).withColumn("slot", F.lit(4))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# -- 1 -----------------------------------------------------------------------------------------------------------------


def test_quality_base_rules_by_brute_force(docs, labels):
    got = by_id(quality_llr.quality_rules(docs, labels))
    assert len(got) == len(ROWS)
    for i, t in TEXT.items():
        w = words(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(words(line)) and line in seen
            seen.add(line)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for j in range(3)}
        r = got[i]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert r.kept <= (not r.base_failed)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert all(got[i].kept for i in good if i is not None and not got[i].base_failed)  # below the threshold without their own counts only


def test_quality_scores_follow_the_ratio(spark, labels):
    """The counted multinomials give the scores, and junk scores below prose."""
    config = quality_llr.QualityConfig(buckets=64)
    rows = [(k, ("good words here again " if k % 4 else "| $$$ || &&& ") * 20) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(20)], "doc_id long, quality int")
    counts = {r.cell: (r.raw, r.target) for r in quality_llr.ngram_counts(quality_llr.marked(docs, told, quality_llr.Scratch(spark)), config).collect()}
    assert sum(r for r, _ in counts.values()) == sum(2 * len(words(t)) - 1 for _, t in rows)
    assert sum(t for _, t in counts.values()) == sum(2 * len(words(t)) - 1 for k, t in rows if k < 20 and k % 4)
    got = by_id(quality_llr.quality_rules(docs, told, config))
    assert all((got[k].llr > 0) == bool(k % 4) for k, _ in rows)
    assert all(got[k].kept == (not got[k].base_failed and bool(k % 4)) for k, _ in rows)


def test_quality_scores_and_threshold_by_brute_force(spark):
    """The ratio n-gram by n-gram, and a threshold from trusted texts that are left out of the target one by one."""
    rng = random.Random(6)
    config = quality_llr.QualityConfig(buckets=128, prior=2.0, refused=0.1)
    pools = ["Alpha beta gamma delta éps".split(), "zu ze zi zo za".split()]
    rows = [(k, " ".join(rng.choice(pools[k % 3 == 0]) if rng.random() < 0.9 else f"x{rng.randrange(99)}" for _ in range(rng.randrange(40, 120)))) for k in range(60)]
    told = [(k, int(k % 3 != 0)) for k in range(0, 60, 2)]
    docs, labels = spark.createDataFrame(rows + [(None, "zu ze"), (99, None), (98, "")], "doc_id long, text string").repartition(4), spark.createDataFrame(told + [(None, 1), (2, 1)], "doc_id long, quality int")
    texts = [t for _, t in rows] + ["zu ze", "", ""]

    def grams(text):
        (chunk,) = [c for _, c in presplit.chunks(pa.array([text]), lower=True)] or [None]
        return Counter(quality_llr._cells(chunk, 128)[0].tolist())

    each = [grams(t) for t in texts]
    raw, good = sum(each, Counter()), {k for k, q in told if q}
    target = sum((each[k] for k in good), Counter())
    p_raw = {c: (raw[c] + 1) / (raw.total() + 128) for c in range(128)}

    def score(g, own):
        total = target.total() - own.total() + 256
        return sum(n * (math.log((target[c] - own[c] + 256 * p_raw[c]) / total) - math.log(p_raw[c])) for c, n in g.items()) / max(1, g.total())

    got = {r.doc_id: r for r in quality_llr.quality_rules(docs, labels, config).collect()}
    assert all(math.isclose(got[k].llr, score(each[k], Counter()), abs_tol=1e-9) for k in range(60))
    left_out = sorted(math.floor(score(each[k], each[k]) * 1000) for k in good if not got[k].base_failed)
    threshold = left_out[int(0.1 * len(left_out))] / 1000
    assert math.isclose(quality_llr.fit(docs, labels, config).threshold, threshold, abs_tol=1e-3)
    assert all(r.kept == (not r.base_failed and r.llr >= threshold) for r in got.values() if abs(r.llr - threshold) > 2e-3)
    some = quality_llr.marked(docs, labels, quality_llr.Scratch(spark))
    assert some.where("trusted").count() == len(good) and some.count() == 63


def test_keep_good_keeps_columns(odd, labels, spark):
    assert quality_llr.keep_good(odd, labels).columns == odd.columns
    assert quality_llr.quality_rules(odd, labels).count() == 4
    assert quality_llr.quality_rules(odd.limit(0), labels.limit(0)).count() == 0


# -- 2 -----------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    rows, told = [], []
    for k in range(400):
        sentences = [prose(rng, 8).replace("\n", " ").replace(".", "") + "." for _ in range(rng.randrange(2, 6))]
        toxic = k % 3 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = "you awful " + rng.choice(["gribble", "frobnik", "zorgles"]) + " there."
        rows.append((k, " ".join(sentences)))
        told.append((k, int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "awful gribble")], "doc_id long, text string")
    out = toxicity_mil.toxicity(docs, spark.createDataFrame(told, "doc_id long, toxic int")).collect()
    got = {r.doc_id: r for r in out}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k, _ in rows)
    assert np.mean([got[k].predicted == dict(told)[k] for k in held]) > 0.95
    assert got[1000].score == got[1001].score == 0 and got[None].held_out is False
    text = dict(rows)
    found = [text[k][s.start : s.end] for k, t in told if t for s in got[k].offending]
    assert found and np.mean(["awful" in s for s in found]) > 0.9


def test_toxicity_does_not_grow_with_length(spark):
    """Labelled texts of any length are learnt from, and many clean sentences stay clean."""
    rng = random.Random(2)
    clean = [" ".join(rng.choice("abcdefgh") * 3 + rng.choice("ijklmnop") * 2 for _ in range(8)) + "." for _ in range(300)]
    longest = " ".join(clean * 3)  # 7,200 words
    texts = [longest + " you awful gribble there.", longest, *(" ".join(rng.sample(clean, 4)) for _ in range(2))]
    rows = [(k, texts[k % 4]) for k in range(100)]
    told = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([*rows, (900, " ".join(clean * 60))], "doc_id long, text string")
    got = by_id(toxicity_mil.toxicity(docs, told))
    assert all(got[k].predicted == int(k % 4 == 0) for k, _ in rows)
    assert got[900].predicted == 0 and not got[900].offending
    # However many sentences there are without evidence, or with little, they are as one.
    z, text = np.array([-8.0] * 50_000 + [-4.0] * 1_000), np.zeros(51_000, np.int64)
    assert toxicity_mil.noisy_or(z, -8.0, text, 1, 0.05)[0] < 0.05
    assert toxicity_mil.noisy_or(z[:50_000], -8.0, text[:50_000], 1, 0.05)[0] == 0


def test_toxicity_bounds_total_words(spark):
    """The last text of a class that the bound lets in is whole."""
    docs = spark.createDataFrame([(k, "w " * 100) for k in range(20)], "doc_id long, text string")
    sample = spark.createDataFrame([(k, k % 2 == 0) for k in range(20)], "doc_id long, toxic boolean")
    config = toxicity_mil.ToxicityConfig(toxic_words=250, clean_words=1)
    assert Counter(r.toxic for r in toxicity_mil.within_words(docs, sample, config).collect()) == {True: 3, False: 1}


def test_toxicity_without_labels(docs, labels):
    got = toxicity_mil.toxicity(docs, labels.limit(0).select("doc_id", "toxic"))
    assert got.count() == len(ROWS) and got.agg(F.max("score")).first()[0] == 0
    one = labels.sparkSession.createDataFrame([(k, 1) for k in range(10)], "doc_id long, toxic int")
    n = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(10))
    assert {(r.score, r.predicted) for r in toxicity_mil.toxicity(docs, one).collect()} == {(n / (n + 1), 1)}


def test_toxicity_of_odd_tables(odd):
    """Repeated rows, null ids and clashing columns; an empty table."""
    labels = odd.sparkSession.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    got = toxicity_mil.toxicity(odd, labels).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 6] and got[1] == got[2] and got[3].score == 0
    assert toxicity_mil.toxicity(odd.limit(0), labels).count() == 0


def test_noisy_or_and_its_gradient_on_tiny_bags():
    """The document's likelihood by hand, and a first step of training against differences of it."""
    z, text = np.array([-1.0, 0.5, -7.0, -3.0]), np.array([0, 0, 1, 1])
    s, floor = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(4.0))
    want = [1 - (1 - s[0]) / (1 - floor) * (1 - s[1]) / (1 - floor), 1 - (1 - s[3]) / (1 - floor)]
    assert np.allclose(toxicity_mil.noisy_or(z, -4.0, text, 2, 0.05), want)
    cells = np.array([[0, 1, 2], [3, 4, 5], [0, 1, 6], [3, 4, 5], [7, 8, 9], [7, 8, 9]])
    bags = toxicity_mil.Bags(cells, np.arange(6), np.array([0, 0, 1, 1, 2, 3]), np.array([True, True, False, False]), np.ones(4))
    config = toxicity_mil.ToxicityConfig(cells=16, least_texts=1, steps=400, cost=0.01)

    def loss(w):
        zs = w[cells].sum(axis=1) + w[-1]
        none = np.array([np.prod([1 / (1 + np.exp(zs[k])) for k in np.flatnonzero(bags.text == d)]) for d in range(4)])
        return -np.mean(np.where(bags.toxic, np.log(1 - none), np.log(none))) + 0.01 * 0.25 * np.abs(w[:-1]).sum()

    w = toxicity_mil.train(bags, config)
    # Nothing nearby is better: the trained weights are at a least loss.
    rng = np.random.default_rng(0)
    assert loss(w) < loss(np.append(np.zeros(16), config.bias))
    assert all(loss(w + d) > loss(w) - 0.01 for d in rng.normal(0, 0.3, (200, 17)))
    assert w[0] > 0 and w[7] <= 0


# -- 3 -----------------------------------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    rng = random.Random(2)
    kinds = {"clean": "aa ab ac ad ae".split(), "low": "ba bb bc bd be".split(), "toxic": "ca cb cc cd ce".split()}
    rows, told = [], []
    for k in range(300):
        kind = ("clean", "clean", "low", "toxic")[k % 4]
        other = rng.choice(list(kinds))
        rows.append((k, " ".join(rng.choice(kinds[other if rng.random() < 0.2 else kind]) for _ in range(rng.randrange(5, 60)))))
        told.append((k, int(kind != "low"), int(kind == "toxic")))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    config = mixing.MixConfig(targets={"clean": 0.6, "low": 0.3, "toxic": 0.1})
    got = mixing.document_rates(docs, lab, config).toPandas()
    assert sorted(got.doc_id) == [r[0] for r in rows] and (got.rate >= 0).all()
    assert (got.sort_values("doc_id").n_tokens.to_numpy() == [len(words(t)) for _, t in rows]).all()
    p, t = got[["p_toxic", "p_clean", "p_low"]].to_numpy(), got.n_tokens.to_numpy()
    share = (p * (t * got.rate.to_numpy())[:, None]).sum(0) / t.sum()
    assert np.allclose(share, [0.1, 0.6, 0.3], atol=2e-5)
    # Brute force: plain projected gradient on every document, in the same metric.
    unit = t.sum() / (p * t[:, None]).sum(0)
    r = np.ones(len(t))
    for _ in range(4000):
        r = np.maximum(0, r - 0.2 * (p @ (unit * ((p * (t * r)[:, None]).sum(0) / t.sum() - [0.1, 0.6, 0.3]))))
    assert np.abs(r - got.rate).max() < 0.02


def test_mixing_edge_cases(docs, labels, odd):
    got = mixing.document_rates(docs, labels)
    assert sorted(r.doc_id for r in got.collect()) == sorted(TEXT)
    assert mixing.document_rates(odd, labels).count() == 4
    assert mixing.document_rates(docs.limit(0), labels.limit(0)).count() == 0
    kept = mixing.mix(odd, labels, mixing.MixConfig(multiples=True, targets={"clean": 1.0, "low": 1.0, "toxic": 1.0}))
    assert kept.columns == odd.columns and kept.count() == 4


# -- 4 -----------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_by_brute_force(docs):
    got = by_id(secrets.digests(secrets.find_secrets(docs)))
    assert len(got) == len(ROWS)
    for i, t in TEXT.items():
        want = base_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[2] == k for s in want) for k in ("assign", "access", "hex"))
    assert any(r.spans.startswith("pem:") for r in got.values())


def test_the_ledger_scans_only_what_is_new(spark, docs, tmp_path):
    ledger = secrets.BlobLedger(spark, f"file://{tmp_path}/ledger")
    old = secrets.BASE_RULES[:1]
    secrets.find_secrets(docs.where("doc_id < 60"), ledger, old).count()
    blobs = {hashlib.sha256(t.encode()).hexdigest() for i, t in TEXT.items() if i < 60}
    assert {r.blob: tuple(r.rules) for r in ledger.read().collect()} == dict.fromkeys(blobs, ("assign@1",))
    got = by_id(secrets.digests(secrets.find_secrets(docs, ledger)))
    seen = Counter((r.blob, rule) for r in ledger.read().collect() for rule in r.rules)
    assert max(seen.values()) == 1 and len({b for b, _ in seen}) == len(set(TEXT.values()))
    assert all(len(base_spans(t)) == got[i].n_assign + got[i].n_access + got[i].n_hex for i, t in TEXT.items())


def test_digests_do_not_depend_on_what_was_scanned_before(spark, docs, tmp_path):
    """A span's place in the order follows from its kind, not from the list of rules of the scan that found it."""
    ledger = secrets.BlobLedger(spark, f"file://{tmp_path}/ledger")
    some = docs.where("doc_id >= 50")
    secrets.find_secrets(some, ledger, secrets.MORE_RULES).count()
    got = by_id(secrets.digests(secrets.find_secrets(some, ledger, secrets.RULES[::-1])))
    assert got == by_id(secrets.digests(secrets.find_secrets(some)))


def test_many_hits_in_one_text(spark):
    """Time follows the number of hits: 50,000 of them, placed and masked."""
    n = 50_000
    text = " é".join(f"{k:024x}" for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    (found,) = secrets.find_secrets(docs).collect()
    assert [(s.start, s.end) for s in found.spans] == [(26 * k, 26 * k + 24) for k in range(n)]
    (clean,) = secrets.redact_secrets(docs).collect()
    assert clean.text == " é".join(["[secret]"] * n)
    assert time.perf_counter() - began < 120


def test_overlapping_spans_are_masked_once(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 4)
    monkeypatch.setattr(secrets, "STRIDE", 2)
    rng = random.Random(4)
    rows = []
    for k in range(200):
        text = "".join(rng.choice("abcé\n漢😀") for _ in range(rng.randrange(1, 40)))
        spans = sorted(sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(rng.randrange(1, 8)))
        rows.append((k, text, [a for a, _ in spans], [b for _, b in spans]))
    df = spark.createDataFrame(rows, "k int, text string, starts array<long>, ends array<long>")
    got = {r.k: r.out for r in df.select("k", secrets.masked(F.col("text"), F.col("starts"), F.col("ends"), "#").alias("out")).collect()}
    for k, text, starts, ends in rows:
        out, at = "", 0
        for a, b in zip(starts, ends, strict=True):
            if a >= at:
                out += text[at:a] + "#"
            at = max(at, b)
        assert got[k] == out + text[at:]


def test_redaction(docs, odd):
    got = by_id(secrets.redact_secrets(docs))
    for i, t in TEXT.items():
        if base_spans(t):
            assert "[secret]" in got[i].text and not base_spans(got[i].text) and got[i].n_chars == len(got[i].text)
        elif "PRIVATE" not in t:
            assert got[i].text == dict((r[0], r[1]) for r in ROWS)[i]
    assert secrets.redact_secrets(odd).columns == odd.columns and secrets.redact_secrets(odd).count() == 4
    assert secrets.find_secrets(odd.limit(0)).count() == 0


def test_redaction_of_whole_private_keys(spark):
    begin, end, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n".join(["Ab+/" * 16] * 3)
    texts = [f"é {begin}\n{body}\n{end} after", f"{begin}\nDEK-Info: AES-128-CBC,0A\n\n{body}\n{end}\n{begin}\n{body}\n{end}", f"{begin}\n{body}\nthat was all", f"a {begin} line of prose"]
    got = by_id(secrets.redact_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].text for i in range(4)] == ["é [secret] after", "[secret]\n[secret]", "[secret] was all", "a [secret] line of prose"]


# -- 5, 8, 9 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(llm.tokenizer_path())


def test_automaton_equals_the_library(library):
    with open(llm.tokenizer_path(), encoding="utf-8") as f:
        codec = Codec(compile_merges(f.read()))
    rng = random.Random(3)
    letters = "etaoinshrdlu ETA  '\n\t.,;0123éß漢字 \x85"
    texts = [*TEXT.values(), *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)), "e" * 3001, " " * 999]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(t) == want.ids
        assert codec.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
    at = 0
    for row, chunk, ids, ends in codec.batches(pa.array(texts)):
        assert row == at
        for k in range(chunk.n):
            assert ids[ends[k] : ends[k + 1]].tolist() == codec.encode(texts[row + k])
        at += chunk.n
    assert at == len(texts)


def test_words_are_split_by_the_rule():
    """Against the pattern itself, on texts that mix every kind of edge."""
    rng = random.Random(1)
    parts = ["a", "b", "'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "  ", "\n", "\t", "1", "2", "!", "é", "漢", "\xa0", "\x85", "'s", "'re", "'ll", "Ⅷ", "½", "\u2003", "😀", "A", "'S", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(20_000)] + ["", "'", " '", "'s", " 's", "x's", "don't", "\n's", " "]
    find = regex.compile(presplit.SPLIT).findall
    for row, chunk in presplit.chunks(pa.array(texts)):
        starts = presplit.word_starts(chunk)
        words_of = np.split(starts, np.searchsorted(starts, chunk.offsets[1:-1]))
        for k in range(chunk.n):
            at = np.append(words_of[k], chunk.offsets[k + 1]).tolist()
            assert [chunk.data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == find(texts[row + k])
    assert all((presplit.classes()[ord(c)] == kind) == bool(regex.match(p, c)) for c in map(chr, rng.sample(range(0x110000), 5000)) if not 0xD800 <= ord(c) < 0xE000 for kind, p in ((presplit.LETTER, r"\p{L}"), (presplit.NUMBER, r"\p{N}"), (presplit.SPACE, r"\s")))


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(presplit, "REMEMBERED_WORDS", 50)
    monkeypatch.setattr(presplit, "PLACES", 64)
    calls = []
    coder = presplit.WordEncoder(lambda ws: [calls.append(w) or list(w) for w in ws])
    texts = [" ".join(f"w{(k * j) % 97}" for j in range(20)) + " " + "long" * 40 for k in range(60)]
    for t in texts:
        for _, chunk in presplit.chunks(pa.array([t, "", t])):
            ids, ends = coder.chunk(chunk)
            assert bytes(ids.astype(np.uint8)) == t.encode() * 2 and ends.tolist() == [0, len(t), len(t), 2 * len(t)]
    assert coder.words < 200


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"normalizer": {"type": "NFC"}}, {"model": {"type": "WordPiece"}}])
def test_other_tokenizers_are_refused(change):
    with open(llm.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    with pytest.raises(ValueError):
        presplit.check_tokenizer(json.dumps(spec | change))


def test_automaton_of_few_merges_by_brute_force():
    rng = random.Random(5)
    for _ in range(15):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        while len(merges) < 9:
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append([u, v])
        codec = Codec(compile_merges(json.dumps({"pre_tokenizer": {"type": "ByteLevel"}, "model": {"vocab": vocab, "merges": merges}, "added_tokens": []})))
        for _ in range(80):
            t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            parts = list(t)
            for u, v in merges:
                k = 0
                while k < len(parts) - 1:
                    if parts[k] == u and parts[k + 1] == v:
                        parts[k : k + 2] = [u + v]
                    k += 1
            assert [codec.automaton.labels[i].decode() for i in codec.automaton.word(t.encode(), {})] == parts


def test_codec_query(docs, odd, library):
    got = by_id(bpe_digests(encode_texts(docs, llm.tokenizer_path())))
    for i, t in TEXT.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert encode_texts(odd, llm.tokenizer_path()).count() == 4


def test_token_counts_by_brute_force(spark, docs, library):
    lengths = [len(library.encode(t, add_special_tokens=False).ids) for t in TEXT.values()]
    got = {r.length: r for r in token_counts.suffix_sums(token_counts.length_histogram(docs, llm.tokenizer_path()), block=7).collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for n, r in got.items():
        longer = [x for x in lengths if x >= n]
        assert (r.docs_at_least, r.tokens_at_least, r.truncated_total) == (len(longer), sum(longer), sum(min(x, n) for x in lengths))
        assert math.isclose(r.share_no_longer, sum(x <= n for x in lengths) / len(lengths))
    hist = token_counts.length_histogram(docs, llm.tokenizer_path()).cache()
    assert [tuple(r) for r in token_counts.truncated_totals(hist, [0, 10, 10**6]).collect()] == [(k, sum(x > k for x in lengths), sum(min(x, k) for x in lengths)) for k in (0, 10, 10**6)]
    assert [r.length for r in token_counts.quantiles(hist, [0.5, 1.0]).collect()] == [sorted(lengths)[math.ceil(len(lengths) / 2) - 1], max(lengths)]
    assert token_counts.suffix_sums(hist.limit(0)).count() == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 15, 16, 17, 100, 256, 257, 3000):
        for ids in (rng.integers(0, 50257, n), rng.integers(0, 2**32, n), np.zeros(n, int), rng.integers(0, 20, n), np.tile([5, 7, 70000], n)[:n]):
            blocks = rangecoder.encode_blocks(ids.astype(np.uint32), 256)
            assert (rangecoder.decode_blocks(blocks, n, 256) == ids).all()
    alike = np.tile(np.arange(40), 200).astype(np.uint32)
    blocks = rangecoder.encode_blocks(alike)
    assert sum(map(len, blocks)) < len(alike) / 4
    assert sum(map(len, rangecoder.encode_blocks(rng.geometric(0.02, 30_000).astype(np.uint32)))) * 8 < 30_000 * 8  # entropy 7.1 bits
    one = rangecoder.encode_blocks(alike[:500], 250)
    assert (rangecoder.decode_blocks(one[1:], 250, 250) == alike[250:500]).all()
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([blocks[0][:40] + bytes([blocks[0][40] ^ 1]) + blocks[0][41:]], len(alike))


def test_token_files(spark, docs, odd, library, tmp_path):
    got = by_id(rangecoder.round_trip(docs, llm.tokenizer_path(), rangecoder.CodeConfig(segment=2000)))
    at = 0
    for i, t in TEXT.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rangecoder.write_ids(docs, llm.tokenizer_path(), f"file://{tmp_path}/ids")
    whole = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rangecoder.read_segments(spark, f"file://{tmp_path}/ids").collect()}
    assert whole == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in TEXT.items()}
    assert rangecoder.round_trip(odd, llm.tokenizer_path()).count() == 4
    assert rangecoder.round_trip(docs.limit(0), llm.tokenizer_path()).count() == 0


# -- 6, 7 --------------------------------------------------------------------------------------------------------------


def weighted_jaccard(a, b):
    x, y = Counter(words(lowered(a))), Counter(words(lowered(b)))
    top = sum(max(x[k], y[k]) for k in x | y)
    return sum(min(x[k], y[k]) for k in x | y) / top if top else 1.0


def test_weighted_fingerprints(docs):
    config = cws.SamplingConfig(range_rows=9)
    got = by_id(cws.fingerprint_edits(docs, config))
    order = sorted(TEXT, reverse=True)
    errors = []
    for k, i in enumerate(order):
        t, other, r = TEXT[i], TEXT[order[(k + 1) % len(order)]], got[i]
        half = len(t) // 2
        change = t[: len(t) - half] + other[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(change.encode()).hexdigest())
        errors += [r.near_edited - weighted_jaccard(t, change), r.near_next - weighted_jaccard(t, other)]
        assert (r.fingerprint == r.edited_fingerprint) or change != t
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.12
    assert len({got[i].fingerprint for i in TEXT if TEXT[i] == TEXT[0]}) == 1
    whole = by_id(cws.fingerprint_edits(docs))
    assert all(whole[i].fingerprint == got[i].fingerprint for i in TEXT)


def test_long_texts_of_other_words_are_unlike(spark):
    """Texts of 20,000 distinct words each that share none, and ones that share half of them."""
    texts = [" ".join(f"a{k}" for k in range(20_000)), " ".join(f"b{k}" for k in range(20_000)), " ".join(f"a{k}" for k in range(10_000, 30_000))]
    got = {r.doc_id: r.s for r in cws.fingerprint_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cws.SamplingConfig(samples=256)).collect()}
    alike = lambda a, b: np.mean([x == y for x, y in zip(got[a], got[b], strict=True)])
    assert alike(0, 1) == 0 and alike(1, 2) == 0 and abs(alike(0, 2) - 1 / 3) < 0.1


def test_weighted_fingerprints_of_odd_tables(odd, spark):
    assert cws.fingerprint_edits(odd).count() == 4
    assert cws.fingerprint_edits(odd.limit(0)).count() == 0
    (one,) = cws.fingerprint_edits(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a ba ").hexdigest()


def test_shards_share_evenly_and_move_little(spark, odd):
    config = sharding.ShardConfig()
    table = sharding.fill(config)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 64
    fewer = sharding.fill(sharding.ShardConfig(shards=config.shards[:-1]))
    names, left = sorted(config.shards), sorted(config.shards[:-1])
    moved = sum(names[a] != left[b] for a, b in zip(table, fewer, strict=True) if names[a] != config.shards[-1])
    assert moved < 0.05 * len(table)
    # By hand, for seven slots: each shard in turn takes the first free slot of its own order.
    small = sharding.ShardConfig(shards=("x", "y", "z"), slots=7)
    left, want = set(range(7)), {}
    orders = {}
    for n in "xyz":
        at, skip = (int(hashlib.md5(f"{n}#{w}".encode()).hexdigest()[:15], 16) for w in ("offset", "skip"))
        orders[n] = [(at + k * (skip % 6 + 1)) % 7 for k in range(7)]
    while left:
        for k, n in enumerate("xyz"):
            if left:
                slot = next(x for x in orders[n] if x in left)
                left.remove(slot)
                want[slot] = k
    assert sharding.fill(small) == [want[k] for k in range(7)]
    heavy = Counter(sharding.fill(sharding.ShardConfig(shards=("a", "b"), slots=101, weights={"a": 3})))
    assert 2.5 < heavy[0] / heavy[1] < 3.5
    placed = sharding.place(spark.range(2000).withColumnRenamed("id", "doc_id"), "doc_id", config)
    for r in placed.collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % config.slots
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert set(sharding.place(odd, "doc_id").columns) == {*odd.columns, "shard"}
    clash = odd.select("doc_id", "slot", F.lit(1).alias("_at"), F.lit(2).alias("_TO"), F.lit(3).alias("_slot"), F.lit(4).alias("Shard"))
    out = sharding.place(clash, "doc_id")
    assert out.columns == ["doc_id", "_at", "_TO", "_slot", "slot", "shard"]
    empty = int(hashlib.md5(b"").hexdigest()[:15], 16) % config.slots
    assert [(r._at, r._TO, r._slot) for r in out.collect()] == [(1, 2, 3)] * 4 and [r.slot for r in out.where("doc_id is null").collect()] == [empty]
    by_slot = sharding.place(odd, "slot")
    assert by_slot.select("slot").distinct().collect()[0][0] == 4 and {"slot", "slot_", "shard"} <= set(by_slot.columns)
    with pytest.raises(ValueError):
        sharding.fill(sharding.ShardConfig(shards=()))


# -- 10 ----------------------------------------------------------------------------------------------------------------


def components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = words(lowered(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(docs, k, percent):
    got = by_id(minhash.near_duplicates(docs, minhash.NearConfig(k, percent)))
    want, sizes = components(TEXT, k, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_a_family_near_the_threshold_by_brute_force(spark, monkeypatch):
    """Many texts around one base, some linked and some not; parts and pivots of a large group."""
    monkeypatch.setattr(minhash, "PART_TEXTS", 7)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(90):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(150)] = f"x{i}-{rng.randrange(10**6)}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {i: r.component_id for i, r in by_id(minhash.near_duplicates(docs, minhash.NearConfig(3, 85))).items()}
    assert got == components(texts, 3, 85)[0]


def test_sketch_coordinates_agree_as_sets_do():
    rng = np.random.default_rng(0)
    for n in (3, 60, 800):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n // 2 : n // 2 + n]
        x = minhash.fast_similarity_sketch(np.concatenate([a, b]), np.repeat([0, 1], n), 2, 500)
        assert (x != np.uint64(2**64 - 1)).all()
        want = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((x[0] == x[1]).mean() - want) < 0.08


def test_packed_parts_bound_what_sets_share():
    """Equal sets pass, though two elements of each have one code."""
    one = [{"rep": k, "component": k, "minor": True, "codes": [-3, 7, 7, 9]} for k in (1, 2)]
    part = minhash._Part(pa.array(one, pa.struct([("rep", pa.int64()), ("component", pa.int64()), ("minor", pa.bool_()), ("codes", pa.list_(pa.int32()))])))
    left, right = minhash.compare_parts(part, part, 100)
    assert (left.tolist(), right.tolist()) == ([1], [2]) and part.collapsed.tolist() == [1, 1]


def test_a_low_threshold_by_brute_force(spark):
    """Bands follow from the threshold: at 20 per cent as many as it takes."""
    rng = random.Random(11)
    texts = {i: " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 14))) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    config = minhash.NearConfig(1, 20)
    bands, rows = config.shape
    assert (1 - 0.2**rows) ** bands <= minhash.MISS and bands * rows <= 500
    assert {i: r.component_id for i, r in by_id(minhash.near_duplicates(docs, config)).items()} == components(texts, 1, 20)[0]
    with pytest.raises(ValueError):
        minhash.NearConfig(3, 0).shape


def test_near_duplicates_of_odd_tables(odd):
    out = minhash.near_duplicates(odd)
    assert [(r.doc_id, r.kept) for r in out.orderBy("doc_id").collect()] == [(None, True), (5, True), (5, True), (6, True)]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 4


def test_pattern_is_the_published_one():
    import public_tokenizers

    from gleanery.llm.presplit import SPLIT

    assert regex.compile(SPLIT) == regex.compile(public_tokenizers.PATTERN)


def test_pipeline_keeps_columns_and_takes_effect(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "tokens":
            assert new.columns == columns
        assert 0 < new.count() <= docs.count()
        docs = new
    assert sorted(docs.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents as a folder of tables: near copies, secrets, nulls, empty texts, repeated rows, and columns with inner names."""
    rng = random.Random(12)
    base = [prose(rng, 90).replace("\n", " ") for _ in range(24)]
    texts = dict(enumerate(base))
    for k in range(6):  # near copies of the first text
        own = base[0].split(" ")
        for _ in range(k):
            own[rng.randrange(len(own))] = "other"
        texts[100 + k] = " ".join(own)
    texts |= {200: base[5] + ' password = "abc123def" end', 201: base[6] + f" AKIA{'A1' * 9} tail", 202: "junk " * 80, 203: "too few", 204: "", 205: None, 206: base[7] + " " + "long " * 3000}
    rows = [(i, t, "en", "s", len(t) if t is not None else None, True, 7) for i, t in texts.items()] + [(3, base[3], "en", "s", len(base[3]), True, 7), (None, base[8], "en", "s", len(base[8]), True, 7), (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _gone int"
    at = tmp_path_factory.mktemp("corpus")
    told = [(i, int(i % 3 != 0), int(i % 11 == 0)) for i in texts if i % 2 == 0] + [(None, 1, 0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_each_stage_by_brute_force(spark, corpus, library):
    """Every stage on what the one before it kept, row by row."""
    import corpus_pipeline

    order = lambda rows: sorted(rows, key=repr)
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    docs = spark.read.parquet(f"{corpus}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "near_copies", "secrets", "mixture"):
        before, out = docs.collect(), stages[name](spark, docs, corpus).cache()
        assert out.columns == docs.columns
        after = out.collect()
        if name == "quality":
            verdict = {}
            for r in quality_llr.quality_rules(docs, labels).collect():
                verdict.setdefault(r.doc_id, []).append(r.kept)
            want = [r for r in before if r.doc_id is not None and verdict[r.doc_id][0]] + [r for r in before if r.doc_id is None and r.text and any(verdict[None])]
            assert 0 < len(after) < len(before) and all(len(words(r.text)) >= 50 for r in after)
        elif name == "near_copies":
            parts, _ = components({r.doc_id: r.text for r in before if r.doc_id is not None}, 5, 80)
            want = [r for r in before if r.doc_id is None or parts[r.doc_id] == r.doc_id]
            assert len(want) < len(before)
        elif name == "secrets":
            plain = {r.doc_id: r for r in before}
            for r in after:
                old = plain[r.doc_id].text
                spans = base_spans(old)
                assert not base_spans(r.text) and ("[secret]" in r.text) == bool(spans) and r.n_chars == (len(r.text) if spans else plain[r.doc_id].n_chars)
                assert spans or r.text == old
            want = after if len(after) == len(before) else None
        else:
            rate = {r.doc_id: r.rate for r in mixing.document_rates(docs, labels, corpus_pipeline.MIX).collect()}
            drawn = {r.doc_id: r.x for r in docs.select("doc_id", mixing.draw("doc_id", corpus_pipeline.MIX.seed).alias("x")).collect()}
            want = [r for r in before if r.doc_id is None or drawn[r.doc_id] < rate[r.doc_id] or rate[r.doc_id] >= 1]
        assert order(after) == order(want)
        docs = out
    got = stages["tokens"](spark, docs, corpus).collect()
    ids = [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids, r.text) for r in docs.collect()]
    want = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids]
    assert order((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == order(want)
    assert order(tuple(r) for r in corpus_pipeline.run(spark, corpus).collect()) == order(tuple(r) for r in got)


def test_the_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_posteriors_by_brute_force(spark):
    """Naive Bayes over hashed words, word by word."""
    rng = random.Random(13)
    rows = [(k, " ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(rng.randrange(0, 70)))) for k in range(60)]
    told = [(k, int(k % 3 != 0), int(k % 7 == 0)) for k in range(0, 60, 2)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    config = mixing.MixConfig(buckets=16)
    got = {r.doc_id: r for r in mixing.document_rates(docs, labels, config).collect()}
    cell = {r.w: r.c for r in spark.createDataFrame([(w,) for w in "aa bb cc dd ee ff".split()], "w string").select("w", mixing._cell("w", config).alias("c")).collect()}
    domain = {k: "toxic" if t else "clean" if q else "low" for k, q, t in told}
    counts = {d: Counter(cell[w] for k, t in rows if domain.get(k) == d for w in t.split()) for d in ("toxic", "clean", "low")}
    size = Counter(domain.values())
    for k, t in rows:
        own = t.split()
        weight = min(len(own), 40) / max(1, len(own))
        z = {d: math.log((size[d] + 1) / (len(domain) + 3)) + weight * sum(math.log((c[cell[w]] + 0.5) / (c.total() + 8)) for w in own) for d, c in counts.items()}
        top = max(z.values())
        p = {d: math.exp(x - top) for d, x in z.items()}
        assert all(abs(p[d] / sum(p.values()) - got[k][f"p_{d}"]) < 6e-4 for d in p)


def test_one_id_that_many_rows_share(spark, library):
    """Repeated and null ids spread over shards; every row is there, and the files are in order."""
    rows = [(5, f"text {k} of one id") for k in range(300)] + [(None, f"none {k}") for k in range(100)] + [(k, f"own {k}") for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rangecoder.round_trip(docs, llm.tokenizer_path()).collect()
    want = Counter((i, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    placed = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in placed] == [None] * 100 + [5] * 300 + list(range(10, 60))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(placed, placed[1:]))


def test_all_are_registered():
    names = list(e.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
