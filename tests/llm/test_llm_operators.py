"""Each operator against a brute-force version, on small tables and on odd ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import common, decontaminate, exact_dedup, filters, langid, licenses, packing, pii, quality, sharding, simhash, store, tokens
from quillspark.llm.queries import BYTE_TOKENIZER, ORACLES, QUERIES, WORD_TOKENIZER
from quillspark.llm.tokens import Encoder, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _order string, shard string, digest string, fp long, keep_id long, component_id long, sequence_id long, _rank long, __quill_hits string, __quill_key string, __quill_copy string"
CLASH = ("o", "h", "d", 7, 7, 7, 7, 7, "q", "k", "c")
ODD = [None, "", " ", "a", "the same words here", "the same words here", "The  same\twords here", "é ü", "x" * 3000, "word " * 3000, "42", "<|endoftext|> İ 日本", "All rights reserved.\nand more"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeated rows, and columns whose names the operators use."""
    rows = [(k, t, None if k % 3 else "en", None if k % 4 == 0 else "s", None, *CLASH) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "the same words here", None, None, None, *CLASH)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def columns(df):
    return [tuple(r) for r in df.collect()]


# 1


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return by


def test_sharding(docs, odd, empty, texts):
    rows = sharding.report(docs).collect()
    check_shards(rows, 8)
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    mix = defaultdict(Counter)
    for r in rows:
        mix[r["source"]][r["shard"]] += 1
    # a cut may part a row of each source, so a shard has its share to within about one row
    for c in mix.values():
        assert max(c[k] for k in range(8)) - min(c[k] for k in range(8)) <= 3
    check_shards(sharding.report(odd).collect(), 8)
    assert sharding.report(odd).count() == odd.count() and sharding.report(empty).count() == 0
    assert "Python" not in sharding.report(docs)._jdf.queryExecution().executedPlan().toString()


def test_sharding_by_brute_force(docs):
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", common.positive_hash(F.lit(11), "doc_id").alias("h")).collect()}
    by = defaultdict(list)
    for r in docs.collect():
        by["1" + r["source"] if r["source"] is not None else "0"].append(r["doc_id"])
    order = []
    for source, own in by.items():
        for rank, d in enumerate(sorted(own, key=hashed.get)):
            order.append((int((rank + 0.5) / len(own) * 2.0**62), hashed[d], d))
    want, n = {}, len(order)
    for at, (_, _, d) in enumerate(sorted(order)):
        shard = at * 8 // n
        want[d] = (shard, at - (shard * n + 7) // 8)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.report(docs).collect()} == want


def test_sharding_of_one_key(spark):
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    rows = rows.unionByName(spark.range(20).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source")))
    check_shards(sharding.report(rows).collect(), 8)


def test_ranks(spark):
    df = common.cut(spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.lit(1).alias("o"), common.row_salt().alias("s")))
    got = common.ranked(df, ["g", "o", "s"], "r").collect()
    assert [r["r"] for r in sorted(got, key=lambda r: (r["g"], r["s"]))] == list(range(500))


# 2


def test_quality(spark, docs, labels, odd, empty):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.report(*base).join(base[1], "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in got]
    assert len(right) > 50 and np.mean(right) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    rows = quality.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality.report(empty, labels).count() == 0 and quality.report(docs, labels.limit(0)).count() == docs.count()


def test_quality_split(docs):
    for r in docs.select("doc_id", quality.held_out().alias("h"), langid.held_out().alias("l")).collect():
        crc = zlib.crc32(str(r["doc_id"]).encode())
        assert r["h"] == (crc % 4 == 2) and r["l"] == (crc % 3 == 1)


def test_pu_risk_finds_the_prior_and_the_classes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(2, 1, (3000, 2)), rng.normal(-2, 1, (1000, 2))])
    one = quality._with_one(x)
    pos, unl = one[:800], one
    prior = quality.estimate_prior(pos, unl)
    assert abs(prior - 0.75) < 0.08
    w = quality.nn_pu(pos, unl, 0.75)
    assert np.mean((one @ w > 0) == (np.arange(4000) < 3000)) > 0.97


def test_quality_uses_few_labels_among_many_documents(spark, caplog):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["meadow", "river", "stone", "winter", "quiet", "house"]) for _ in range(30)) + "."
    bad = lambda: "BUY!!! " * 9 + str(rng.randrange(10**6)) + " | $$$ " * 9
    rows = [(k, good() if k % 2 else bad()) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # 100 labels of 6,000 rows
    labels = spark.createDataFrame([(60 * k + k % 2, k % 2) for k in range(100)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_rows=200)
    scores = model.score(np.array([quality.statistics(t) for _, t in rows]))
    assert model.learned and model.positives > 20 and model.positives + model.negatives + model.unlabelled <= 700
    assert model.learned and scores[1::2].min() > 0.7 > scores[::2].max()
    assert abs(model.prior - 0.5) < 0.15
    none = quality.report(docs, labels.where("quality = 0"))
    assert {tuple(r) for r in none.select("score", "predicted").distinct().collect()} == {(0.5, 0)}
    assert quality.keep_good(docs, labels.limit(0)).count() == 6000 and "nothing could be learned from 0 positives" in caplog.text


def plain_statistics(text):
    """The same figures, counted one by one."""
    raw, out = (text or "").encode(), [0.0] * quality.N_FEATURES
    if not raw:
        return out

    def kind(c):
        c = chr(c)
        return 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t" else 4 if c in "\n\r" else 5 if c in ".,;:'\"()-?" else 6 if c == "!" else 7 if c == "|" else 0 if "a" <= c <= "z" or ord(c) > 127 else 8

    for c in raw:
        out[kind(c)] += 1 / len(raw)
    words, lines, n = raw.split(), raw.split(b"\n"), max(1, len(raw.split()))
    out[9] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    out[10], out[11] = len(set(words)) / n, np.log(len(set(words)) + 1) / np.log(n + 2)
    out[12], out[13] = sum(len(w) for w in words) / n / 10, np.log1p(n) / 10
    parts, at = [], 0
    for k, c in enumerate(raw):
        if chr(c) in "\n\r":
            parts.append(raw[at:k])
            at = k + 1
    parts.append(raw[at:])
    for part in parts:
        kinds = [kind(c) for c in part]
        if sum(x == 1 for x in kinds) / max(1, len(part)) > 0.4:
            out[14] += len(part) / len(raw)
        if sum(x >= 6 for x in kinds) / max(1, len(part)) > 0.06:
            out[15] += len(part) / len(raw)
    out[16], out[17], out[18] = 1 - len(set(lines)) / len(lines), max(map(len, words), default=0) / len(raw), np.log1p(len(lines)) / 10
    return out


def test_quality_by_brute_force(docs, labels, texts):
    model = quality.train(docs, labels)
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in quality.report(docs, labels).collect()}
    some = sorted(texts, key=lambda d: len(texts[d]))[:120]
    for d, text in [*((d, texts[d]) for d in some), *((None, t) for t in ODD)]:
        x = plain_statistics(text)
        assert np.allclose(quality.statistics(text), x)
        wide = np.array([*x, *np.sqrt(x), *(v > 0.02 for v in x)])
        z = float(((wide - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1])
        score = 1 / (1 + np.exp(-(model.slope * z + model.shift)))
        if d is not None:
            assert np.isclose(got[d][1], score) and got[d][2] == int(got[d][1] >= 0.7) and got[d][0] == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_pu_weights_are_least():
    rng = np.random.default_rng(7)
    x = quality._with_one(np.concatenate([rng.normal(1, 1, (600, 2)), rng.normal(-1, 1, (600, 2))]))
    pos, unl, prior = x[:200], x, 0.5
    loss = lambda z: np.logaddexp(0, -z).mean()

    def risk(w):
        rest = loss(-(unl @ w)) - prior * loss(-(pos @ w))
        return prior * loss(pos @ w) + max(0, rest) + 5e-4 * w @ w

    w = quality.nn_pu(pos, unl, prior)
    assert all(risk(w) <= risk(w + d) + 1e-4 for d in 0.3 * rng.normal(size=(60, 3)))


def test_quality_weights_stand_for_rows():
    rng = np.random.default_rng(5)
    x, label = rng.random((120, quality.N_FEATURES)), rng.integers(-1, 2, 120)
    order = np.argsort(label, kind="stable")
    x, label = x[order], label[order]
    n = np.where(label == -1, 3, 1)
    one, many = quality.fit(x, label, n.astype(float)), quality.fit(np.repeat(x, n, axis=0), np.repeat(label, n))
    assert np.allclose(one.mean, many.mean) and np.allclose(one.scale, many.scale)
    assert abs(one.prior - many.prior) < 0.1


# 3

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_pattern(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans(texts):
    rng = random.Random(4)
    made = ["".join(rng.choice("ab@..-+ 0123456789()%é\n") for _ in range(rng.randrange(80))) for _ in range(4000)]
    fixed = ["a@b@c.d", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "0001.2.3.255", "4111 1111 1111 1111", "+1 (556) 555-9070 +1 (556) 555-9071", "é4111111111111111é", "", "@", "a" * 500 + "@b.c"]
    for t in [*texts.values(), *made, *fixed]:
        assert pii.base_spans(t) == base_by_pattern(t), t


def test_pii(docs, odd, empty, texts):
    for r in pii.report(docs).collect():
        base = base_by_pattern(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r["spans"].split(","))
    assert pii.report(odd).count() == odd.count() and pii.report(empty).count() == 0


@pytest.fixture(scope="module")
def trees(docs):
    return pii.train(docs)


def planted(rng):
    """Personal data in formats that the base patterns miss."""
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    card = "5" + digits(14)
    card += next(str(k) for k in range(10) if pii.luhn(card + str(k)))
    ip, a, b = [str(rng.randrange(1, 255)) for _ in range(4)], str(rng.randrange(2, 10)) + digits(2), str(rng.randrange(2, 10)) + digits(2)
    yield from (("email", f"{word()}{at}{word()}{dot}com") for at, dot in (("(at)", "(dot)"), (" [at] ", " [dot] "), ("{at}", "."), (" AT ", " DOT "), (" (at) ", ".")))
    yield from (("ip", dot.join(ip)) for dot in ("[.]", " dot ", "(dot)"))
    yield from (("card", gap.join(card[k : k + 4] for k in (0, 4, 8, 12))) for gap in (".", "/", "_", " - "))
    yield from (("phone", x) for x in (f"({a}) {b} {digits(4)}", f"{a} {b} {digits(4)}", f"{a}-{b}-{digits(4)}", f"{a}.{b}.{digits(4)}", f"{a}/{b}-{digits(4)}"))


def test_recall_of_planted_data(trees, texts):
    rng, found, n = random.Random(77), Counter(), Counter()
    prose = [t for t in texts.values() if len(t) > 200]
    for _ in range(60):
        for kind, datum in planted(rng):
            t = rng.choice(prose)
            k = rng.randrange(len(t) - 100)
            words = t[k : k + 80].split(" ")
            before = " ".join(words[1:4]) + " " + (rng.choice(pii.CUES[kind]).strip() + ": " if rng.random() < 0.5 else "")
            text = before + datum + " " + " ".join(words[4:-1])
            n[kind] += 1
            found[kind] += (kind, len(before), len(before) + len(datum)) in pii.all_spans(trees, text, pii.base_spans(text))
    assert all(found[k] >= 0.9 * n[k] for k in n), {k: found[k] / n[k] for k in n}
    wrong = 0
    for _ in range(600):
        words = rng.choice(prose)[:100].split(" ")
        before = " ".join(words[:4]) + " "
        text = before + pii._innocent(rng) + " " + " ".join(words[4:-1])
        wrong += any(a >= len(before) for _, a, _ in pii.all_spans(trees, text, pii.base_spans(text)) if a < len(before) + 20)
    assert wrong <= 0.05 * 600


def test_trees_find_more_and_leave_the_rest(spark):
    model = pii.fit([])
    says = lambda t: [(k, t[a:b]) for k, a, b in pii.all_spans(model, t, pii.base_spans(t))]
    assert ("email", "joe.smith(at)example.com") in says("mail: joe.smith(at)example.com please")
    assert says("call me on phone: 415-555-2671 please") == [("phone", "415-555-2671")]
    for t in ("on 2024-03-05 we met", "version 1.2.3 of it", "we were at home. then", "it cost 1,200,300 in total", "order 12345 of 1999"):
        assert says(t) == []
    many = "4111 1111 1111 1111, 415-555-2671; " * 20_000
    assert len(pii.all_spans(model, many, pii.base_spans(many))) >= 20_000
    df = spark.createDataFrame([(1, "write to a.b@c.de or +1 (556) 555-9070."), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(df, model).orderBy("doc_id").collect()] == ["write to [EMAIL] or [PHONE].", None]


def test_proposals_of_adjoining_numbers_overlap():
    model = pii.fit([])
    cases = [
        ("card", "card {} 12/27", "4111 1111 1111 1111"), ("card", "card {} 12/27", "4111.1111.1111.1111"), ("card", "visa {} 123", "4111 1111 1111 1111"),
        ("phone", "call {} 24 hours", "415-555-2671"), ("phone", "call {} 24 hours", "(415) 555-2671"), ("email", "mail: {} now", "JOE.SMITH(AT)EXAMPLE.COM"),
    ]
    for kind, around, datum in cases:
        text = around.format(datum)
        at = text.index(datum)
        assert (kind, at, at + len(datum)) in pii.candidates(text) and (kind, at, at + len(datum)) in pii.all_spans(model, text, pii.base_spans(text)), text
    for kind, text, datum in [("card", "no 100 200 300 4111 1111 1111 1111 12/27", "4111 1111 1111 1111"), ("ip", "2. 10[.]0[.]0[.]1", "10[.]0[.]0[.]1"), ("phone", "+1 415 555 2671 2024 2025", "+1 415 555 2671")]:
        at = text.index(datum)
        assert (kind, at, at + len(datum)) in pii.candidates(text)


# 4


def brute_contamination(docs, items, window=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            grams[tuple(w[k : k + size])].add(item)
    sizes = {len(g) for g in grams}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (own := grams.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= own
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, benchmark, odd, empty, texts):
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    want = sorted(brute_contamination(texts.items(), items))
    assert sorted(columns(decontaminate.report(docs, benchmark))) == want
    assert any(w[5] for w in want)
    # short items, repeats within a document, and several blocks
    few = [(1, "The same"), (2, "a"), (3, None), (4, "!!"), (5, "word " * 14), (10, "x y z")]
    more = spark.createDataFrame(few, "item_id long, text string")
    plain = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = sorted(brute_contamination([(r["doc_id"], r["text"]) for r in plain.collect()], few))
    assert sorted(columns(decontaminate.report(plain, more))) == want
    hits = decontaminate.contamination(plain, more, out="h", block_words=3).collect()
    assert {r["doc_id"]: (r["h"]["n_words"], sum(b - a for a, b in zip(r["h"]["spans"][::2], r["h"]["spans"][1::2], strict=True)), len(r["h"]["items"])) for r in hits} == {w[0]: w[1:4] for w in want}
    assert decontaminate.report(odd, benchmark).count() == odd.count() and decontaminate.report(empty, benchmark).count() == 0
    assert decontaminate.report(docs, benchmark.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.remove_documents(odd, more)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 0
    assert sorted(columns(decontaminate.report(plain, more, block_words=3))) == want
    cut = decontaminate.remove_spans(plain, spark.createDataFrame([(1, "same words")], "item_id long, text string"))
    assert cut.where("doc_id = 4").first()["text"] == "the  here"


def test_decontamination_by_blocks(spark, docs, benchmark):
    # memory and plan do not grow with the test set: whatever the number of blocks, the plan has one pass
    size = lambda words: decontaminate.report(docs, benchmark, block_words=words)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert size(100) <= 2 and size(500) <= 2
    assert sorted(columns(decontaminate.report(docs, benchmark, block_words=150))) == sorted(columns(decontaminate.report(docs, benchmark)))
    # a long item is cut into parts that lose no window
    item = spark.createDataFrame([("long", " ".join(f"w{k}" for k in range(900)))], "item_id string, text string")
    doc = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(50, 950)))], "doc_id long, text string")
    assert tuple(decontaminate.report(doc, item, block_words=100).first())[1:4] == (900, 850, 1)


def test_items_without_ids_and_with_text_ids(spark):
    items = spark.createDataFrame([("x", "same words"), (None, "same words"), (None, "words here"), ("10", "here")], "item_id string, text string")
    doc = spark.createDataFrame([(1, "the same words here")], "doc_id long, text string")
    for words in (2, 1000):
        row = decontaminate.report(doc, items, block_words=words).first()
        assert (row["n_hit"], row["n_items"], row["items_sha256"]) == (3, 3, hashlib.sha256(b"10,x").hexdigest())


# 5


def brute_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", w)
    if not w:
        return 0
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints(texts):
    for t in [*list(texts.values())[:60], *ODD]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_masks_cover():
    rng = random.Random(2)
    for bits in (list(range(64)), list(range(10, 40)), list(range(7))):
        masks = [m & (2**64 - 1) for m in simhash.covering_masks(bits, 4, 9)]
        assert all(masks) and len(masks) == (31 if len(bits) > 29 else 5)
        for _ in range(2000):
            flipped = sum(1 << b for b in rng.sample(bits, 4))
            assert any(m & flipped == 0 for m in masks)


@pytest.mark.parametrize(("bucket", "clusters"), [(8192, 40), (6, 2)])
def test_links_miss_nothing(spark, bucket, clusters):
    rng = random.Random(bucket)
    fps = set()
    for _ in range(clusters):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = simhash.links(df, bucket=bucket)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in links.collect())
    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.components(links).collect()}
    got |= {f: f for f in fps if f not in got}
    want = brute_components(fps, 4)
    groups = lambda of: sorted(sorted(f for f in fps if of[f] == r) for r in set(of.values()))
    assert groups(got) == groups(want)


def test_near_duplicates(docs, odd, empty, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect()}
    fp = {d: brute_fingerprint(t) for d, t in texts.items()}
    root = brute_components(set(fp.values()), 4)
    least = {}
    for d in sorted(fp):
        least.setdefault(root[fp[d]], d)
    assert got == {d: (f"{fp[d]:016x}", least[root[fp[d]]]) for d in fp}
    rows = simhash.report(odd).collect()
    assert len(rows) == odd.count() and {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {0}
    assert simhash.report(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values())) and kept.columns == docs.columns


ONE_ID = [(5, "A"), (5, "B"), (9, "A"), (2, "A"), (None, "A"), (None, "N"), (None, "N"), (7, "T"), (7, "T")]


def test_rows_are_judged_by_their_own_text(spark):
    df = spark.createDataFrame([(d, t, d) for d, t in ONE_ID], "doc_id long, text string, keep_id long")
    rows = lambda x: sorted(((r["doc_id"], r["text"]) for r in x.collect()), key=str)
    assert rows(simhash.keep_one(df)) == sorted([(2, "A"), (5, "B"), (7, "T"), (None, "N")], key=str)
    assert rows(exact_dedup.keep_one(df)) == sorted([(9, "A"), (5, "B"), (7, "T"), (None, "N")], key=str)
    # one digest for all: bytes decide
    assert rows(exact_dedup.keep_one(df, digest=F.lit("same"))) == rows(exact_dedup.keep_one(df))
    assert rows(exact_dedup.keep_one(df, keep="min")) == rows(simhash.keep_one(df))


# 6


def whole_ids(path, texts, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


@pytest.mark.parametrize("path", [WORD_TOKENIZER, BYTE_TOKENIZER])
def test_encoder_equals_the_library(texts, path):
    rng = random.Random(6)
    letters = "abcXYZ  \n\t''sdtll.!é0½ßſǆ1_ İ中́ \x1c"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    every = [*texts.values(), *ODD, *made, "it's we're 'tis 'S don't I'LL", "a 'b c ' s"]
    got = []
    for ids, lengths in Encoder(path, 9).encode(every):
        got += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == whole_ids(path, every, 9)
    tokens._PART_CHARS, kept = 50, tokens._PART_CHARS
    try:
        assert tokens._segments("ab cd " * 30, 50)[1].startswith(" ")
        own = [x for k in range(0, len(every), 40) for ids, n in Encoder(path, 9).encode(every[k : k + 40]) for x in np.split(ids, np.cumsum(n)[:-1])]
    finally:
        tokens._PART_CHARS = kept
    assert [x.tolist() for x in own] == got
    long = "The quick brown fox, it's été 42 times.\n" * 120_000
    ids, n = next(Encoder(path, 9).encode([long]))
    assert len(tokens._segments(long)) > 2 and n.tolist() == [len(ids)] and ids.tolist() == whole_ids(path, [long], 9)[0]
    assert encoder(path, 9) is encoder(path, 9)


def test_store(spark, docs, odd, empty, texts):
    order = sorted(texts)
    want, start = {}, 0
    for d, ids in zip(order, whole_ids(WORD_TOKENIZER, [texts[d] for d in order], 1), strict=True):
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    path = store.new_store(docs, WORD_TOKENIZER)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in store.summaries(spark, path).collect()}
    assert got == {d: x[:3] for d, x in want.items()}
    assert {r["doc_id"]: r["ids"] for r in store.reconstruct(spark, path).collect()} == {d: x[3] for d, x in want.items()}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    rows = store.summaries(spark, store.new_store(odd, WORD_TOKENIZER)).collect()
    assert len(rows) == odd.count() and len({r["start"] for r in rows}) == len(rows)
    assert store.summaries(spark, store.new_store(empty, WORD_TOKENIZER)).count() == 0


def rewritten(spark, path, part, change):
    rows = common.cut(spark.read.parquet(f"{path}/{part}"))
    change(rows).write.mode("overwrite").parquet(f"{path}/{part}")


def damage(spark, path, what):
    if what == "bytes":
        rewritten(spark, path, "chunks", lambda c: c.withColumn("ids", F.concat("ids", F.lit(b"\x01\x00"))))
    elif what == "chunk":
        gone = spark.read.parquet(f"{path}/chunks").first()["digest"]
        rewritten(spark, path, "chunks", lambda c: c.where(F.col("digest") != F.lit(bytes(gone))))
    elif what == "all chunks":
        rewritten(spark, path, "chunks", lambda c: c.limit(0))
    elif what == "recipe":
        rewritten(spark, path, "recipes", lambda c: c.where("doc_id > 0"))
    elif what == "manifest":
        rewritten(spark, path, "manifest", lambda c: c.where("part <> 0"))
    else:
        for part in ("recipes", "manifest"):
            rewritten(spark, path, part, lambda c: c.where("part <> 0"))


@pytest.mark.parametrize("what", ["bytes", "chunk", "all chunks", "recipe", "manifest", "part"])
def test_store_finds_damage(spark, docs, what):
    path = store.new_store(docs.orderBy("doc_id").limit(20), WORD_TOKENIZER)
    damage(spark, path, what)
    for read in (store.summaries, store.reconstruct):
        with pytest.raises(Exception, match="damaged|missing|manifest"):
            read(spark, path).collect()


def test_chunks_follow_content():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 40_000, 20_000).astype(np.uint32)
    ends = store.chunk_ends(ids, np.array([len(ids)]))[0]
    assert ends[-1] == len(ids) and all(b - a <= store.MAX_IDS for a, b in zip([0, *ends], ends, strict=False))
    moved = np.concatenate([np.arange(100, dtype=np.uint32), ids])
    again = {e - 100 for e in store.chunk_ends(moved, np.array([len(moved)]))[0]}
    assert len(again & set(ends)) > 0.8 * len(ends)


# 7


def test_exact(spark, docs, odd, empty, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("op7_exact_dedup",):
        found = con.execute(ORACLES[name])
        cols = [c[0] for c in found.description]
        assert sorted(columns(QUERIES[name](spark, sf).select(cols))) == sorted(found.fetchall())
    rows = exact_dedup.report(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r["keep_id"] == 5]
    assert len(same) == 5 and {r["group_size"] for r in same} == {5} and [r["doc_id"] for r in same if r["kept"]] == [5]
    assert {r["keep_id"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert exact_dedup.report(empty).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.count() == docs.select("text").distinct().count() and kept.columns == docs.columns


def test_equal_digests_of_unequal_texts(docs):
    weak = F.substring(exact_dedup.sha256_of(F.col("text")), 1, 1)
    good = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.duplicates(docs).collect()}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.duplicates(docs, digest=weak, memtable=20).collect()}
    assert got == good
    least = {r["doc_id"]: r["keep_id"] for r in exact_dedup.duplicates(docs, keep="min").collect()}
    assert all(v <= k for k, v in least.items())


@pytest.mark.parametrize("most", [1 << 10, 1 << 21, filters.FILTER_BITS])
def test_filter_has_all_that_repeat(spark, most):
    index = spark.range(60_000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"), (F.when(F.col("id") % 3 == 0, 2).otherwise(1)).alias("n"))
    found = index.withColumn("may", filters.may_repeat(index, most)(F.col("digest"))).groupBy("n", "may").count().collect()
    counts = {(r["n"], r["may"]): r["count"] for r in found}
    assert (2, False) not in counts and counts[2, True] == 20_000
    assert counts.get((1, True), 0) < (0.3 if most > 1 << 15 else 1.1) * 40_000
    assert not spark.range(1).select(filters.may_repeat(index.where("n = 1"))(F.lit("x")).alias("m")).first()["m"]


def test_index(spark, docs):
    index = exact_dedup.Index(spark, common.shared_path(spark, "index"))
    assert index.entries().count() == 0 and index.lookup(["x"]).count() == 0
    rows = docs.select(exact_dedup.sha256_of(F.col("text")).alias("digest"), "doc_id")
    levels = []
    for k in range(5):
        index.append(rows.withColumn("doc_id", F.col("doc_id") + 1000 * k), memtable=30)
        index.compact()
        levels.append([g["level"] for g in index.generations()])
    # four generations of a level become one of the next
    assert levels == [[0], [0, 0], [0, 0, 0], [1], [1, 0]]
    some = [r[0] for r in rows.limit(3).select("digest").distinct().collect()]
    assert {r["digest"] for r in index.lookup(some).collect()} == set(some)
    before = sorted(columns(index.entries()))
    index.compact(everything=True)
    assert [g["level"] for g in index.generations()] == [2] and sorted(columns(index.entries())) == before
    want = rows.groupBy("digest").agg((F.max("doc_id") + 4000).alias("keep"), (5 * F.count("*")).alias("n"), F.lit(1).alias("ties"))
    assert before == sorted(columns(want))
    # runs are sorted, and ranges of digests do not overlap
    files = spark.read.parquet(index.generations()[0]["path"]).groupBy(F.input_file_name()).agg(F.min("digest").alias("a"), F.max("digest").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(files, files[1:], strict=False))


# 8


def test_language(spark, odd, empty):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(base).join(base.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    rows = {r["doc_id"]: r for r in langid.report(odd).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (0, 1, 2, 10)) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.report(empty).count() == 0


def brute_bits(rows, text):
    """Code length of ``text`` in each language, by recursion."""
    symbols = lambda t: langid._SYMBOL[np.frombuffer(b"   " + t.encode(), np.uint8)].tolist()
    out = []
    for lang in sorted({x for _, x in rows}):
        counts = defaultdict(Counter)
        for t, x in rows:
            s = symbols(t)
            for i in range(3, len(s) if x == lang else 0):
                for o in range(4):
                    counts[tuple(s[i - o : i])][s[i]] += 1

        def p(context, x, counts=counts):
            c = counts[context]
            n, d = sum(c.values()), len(c)
            if c[x]:
                return c[x] / (n + d)
            return (d / (n + d) if n else 1) * (p(context[1:], x) if context else langid._SPREAD[x] / 256)

        s = symbols(text)
        out.append(-sum(np.log2(p(tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s))))
    return out


def test_code_lengths_are_exact():
    rows = [("abracadabra the cat " * 12, "a"), ("the dog barks loud, the cat is there " * 9, "b"), ("über 42 straßen", "c")]
    model = langid.train(rows)
    texts = [rows[0][0], "abracadabra the dog", "zzz ### é日本 12", "", rows[1][0]]
    got = model.lengths([t.encode() for t in texts])
    assert np.allclose(got, [brute_bits(rows, t) for t in texts], rtol=1e-4)
    langid._PART, kept = 21, langid._PART
    pieces = model.lengths([t.encode() for t in texts])
    langid._PART = kept
    assert np.allclose(pieces, got)


def test_whole_predictions(spark, docs, texts):
    """The query's languages and scores against counts and sums made one by one."""
    learned = [(r["text"], r["lang"]) for r in docs.where(~langid.held_out() & F.col("lang").isNotNull()).collect()]
    some = sorted(texts, key=lambda d: len(texts[d]))[:12]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.report(docs).collect()}
    languages = sorted({x for _, x in learned})
    for d in some:
        bits = np.array(brute_bits(learned, texts[d]))
        if not any(c.isalpha() for c in texts[d]):
            assert got[d] == ("und", 0)
            continue
        ahead = (bits - bits.min()) * min(1, langid.TEMPER / max(1, len(texts[d].encode())))
        assert got[d][0] == languages[int(bits.argmin())] and np.isclose(got[d][1], 1 / np.exp2(-ahead).sum(), atol=1e-3)


def test_languages_are_not_capped(spark):
    rows = [(k, "".join(chr(97 + (k % 40 * j) % 26) for j in range(60)), f"l{k % 40:02}") for k in range(400)]
    model = langid.train_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=3)
    assert model.languages == sorted({r[2] for r in rows})
    assert langid.predict(model, ["½ ² ①", "12 !", None])[0] == ["und"] * 3


# 9


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_licenses(spark, odd, empty, licence_model):
    notices = {"gpl": "GNU General Public License", "apache": "Apache License", "mit": "MIT License", "proprietary": "All rights reserved.", "cc-by-nc": "Licensed under CC BY-NC"}
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in base.collect()}
    report = licenses.report(base, licence_model)
    assert "Python" not in report._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["families"] for r in report.collect()}
    assert got == {d: ",".join(sorted(f for f, n in notices.items() if n in t)) for d, t in texts.items()}
    rows = licenses.report(odd, licence_model).collect()
    assert len(rows) == odd.count() and [r["families"] for r in rows if r["doc_id"] == 12] == ["proprietary"]
    assert licenses.report(empty).count() == 0


def test_notices_over_lines_and_families(spark, licence_model):
    cases = [
        ("mit", "Hello there.\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the Software), to deal\n\nnext"),
        ("mit", "The MIT License\n\nother"), ("lgpl", "under the terms of the GNU Lesser General Public License, version 2.1"), ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE"),
        ("apache", "  Apache License\n Version 2.0"), ("bsd", "Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted provided"),
        ("isc", "Permission to use, copy, modify, and/or\n distribute this software for any purpose with or without\n fee is hereby granted"),
        ("mpl", "subject to the terms of the Mozilla Public\nLicense, v. 2.0."), ("epl", "Eclipse Public License - v 2.0"), ("gpl,mit", "MIT License\n\nGNU General Public License"),
        ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("public-domain", "CC0 1.0 Universal"),
        ("", "he had a licence to fish in the river and permission to sail"), ("", "the driving license was lost, all rights to it gone"),
        ("", "Licensed under the Foo Bar Custom License, see terms"), ("", "MIT\n\nis a school; its license office is reserved"), ("mit", "word " * 200_000 + "MIT License " + "word " * 200_000),
    ]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    assert [r["families"] for r in licenses.report(df, licence_model).orderBy("doc_id").collect()] == [f for f, _ in cases]
    assert all(any(c in t.lower() for c in licenses.CUES) for texts in licenses.TEMPLATES.values() for t in texts)


def test_paragraphs_by_brute_force(spark):
    rng = random.Random(12)
    lines = ["", " ", "a b", "the License of", "c", "all rights reserved d", "e f g"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(14))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = set()
    for t in texts:
        own, blank = t.split("\n"), lambda x: not x.strip()
        for k, line in enumerate(own):
            if not any(c in line.lower() for c in licenses.CUES):
                continue
            a = b = k
            while a > max(0, k - licenses.BEFORE) and not blank(own[a - 1]):
                a -= 1
            while b < min(len(own) - 1, k + licenses.AFTER) and not blank(own[b + 1]):
                b += 1
            for part in (line, " ".join(own[a : b + 1])):
                want.add((hashlib.sha256(t.encode()).hexdigest(), k, tuple(part.lower().split())))
    assert {(r["digest"], r["line"], tuple(r["w"])) for r in licenses.paragraphs(df).collect()} == want


def wrapped(text, per_line, between="\n"):
    w = text.split()
    return between.join(" ".join(w[i : i + per_line]) for i in range(0, len(w), per_line))


def test_notices_at_every_position(spark, licence_model):
    mit, lgpl, gpl, domain = (licenses.TEMPLATES[f][k] for f, k in (("mit", 2), ("lgpl", 1), ("gpl", 2), ("public-domain", 0)))
    cases = [
        ("mit", wrapped(mit, 1)), ("mit", wrapped(mit, 2)), ("mit", wrapped(mit, 4, "\n\n")), ("mit", wrapped(" ".join(mit.split()[2:]), 5)),
        ("lgpl", wrapped(lgpl, 1)), ("lgpl", wrapped(lgpl, 3, "\n \n")), ("public-domain", domain.replace("public domain", "public\ndomain")),
        ("proprietary", "All\n\nrights\n\nreserved"), ("gpl,mit", wrapped(mit + " " + gpl, 1)),
        ("apache,mit", "dual licensed under the MIT License or the Apache License, Version 2.0"),
        *[("lgpl", "word\n" * k + wrapped(lgpl, 1) + "\nword" * 300) for k in range(licenses.WINDOW // 2 - 40, licenses.WINDOW // 2 + 10, 3)],
        ("", "the license was\n\nof this software and associated\n\nto any person, all reserved, public\nlife"),
    ]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    rows = licenses.report(df, licence_model).orderBy("doc_id").collect()
    assert [r["families"] for r in rows] == [f for f, _ in cases]
    assert all((r["n_paragraphs"] > 0) == (r["families"] != "") for r in rows)


def test_needed_words_lose_no_text(spark):
    shares = licenses.Shares.of(spark, licenses.CONFIRM)
    needed = licenses.needed(shares.templates, shares.least)
    for _, own in shares.templates:
        without = [p for p in own if not any(x in p for x in needed)]
        assert len(without) / len(own) < shares.least
    assert licenses.needed([(["a", "bbb", "cc", "d"], ["a bbb", "bbb cc", "cc d"])], 0.6) == ["bbb"]


def test_places_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(licenses, "WINDOW", 12)
    shares = licenses.Shares.of(spark, licenses.CONFIRM)
    rng = random.Random(15)
    parts = ["MIT License", "GNU General", "Public", "License", "All rights", "reserved", "Released under the", "BSD License", "x", "y z", "\n", "\n", "\n\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(80)]
    two = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    met = lambda w: [t for _, t in shares.templates if len(set(two(w)) & set(t)) / len(t) >= shares.least]
    want = set()
    for t in texts:
        digest, every = hashlib.sha256(t.encode()).hexdigest(), t.lower().split()
        want |= {(digest, k, tuple(line.lower().split())) for k, line in enumerate(t.split("\n")) if met(line.lower().split())}
        # the last window reaches the end of the text
        for i in range(0, max(1, len(every) - licenses.WINDOW // 2), licenses.WINDOW // 2):
            window = every[i : i + licenses.WINDOW]
            for own in met(window):
                at = [k for k, p in enumerate(two(window)) if p in own]
                want.add((digest, None, tuple(every[max(0, i + at[0] - licenses.MARGIN) : i + at[-1] + 2 + licenses.MARGIN])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {(r["digest"], r["line"], tuple(r["w"])) for r in licenses.paragraphs(df).collect() if met(r["w"])}
    got = {(r["digest"], r["line"], tuple(r["w"])) for r in licenses.places(df, shares).collect()}
    assert got == want | near


def test_template_shares_by_brute_force(spark, licence_model):
    text = "licensed under the GNU General Public License"
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), licence_model).first()
    two = lambda t: set(zip(t.split(), t.split()[1:], strict=False))
    best = max(len(two(re.sub("[^a-z ]", "", t.lower())) & two(text.lower())) / len(two(re.sub("[^a-z ]", "", t.lower()))) for t in licenses.TEMPLATES["gpl"][:1])
    assert found["family"] == "gpl" and found["share"] == best == 1


# 10


def check_packing(rows, pieces_of):
    by, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert {d: sorted(v) for d, v in seen.items()} == pieces_of
    return len(by)


def cut_pieces(ids, capacity=2048):
    out, start = [], 0
    while start < len(ids):
        n = (len(ids) - start) % capacity or capacity
        out.append((len(out), start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
        start += n
    return out


def test_packing(docs, odd, empty, texts):
    rows = packing.pack(packing.token_pieces(docs, BYTE_TOKENIZER)).collect()
    ids = whole_ids(BYTE_TOKENIZER, texts.values(), 0)
    n = check_packing(rows, {d: cut_pieces(x) for d, x in zip(texts, ids, strict=True)})
    assert n <= 1.02 * sum(map(len, ids)) / 2048 + 1
    rows = packing.pack(packing.token_pieces(odd, BYTE_TOKENIZER)).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) for x in whole_ids(BYTE_TOKENIZER, [r["text"] for r in odd.collect()], 0))
    assert packing.pack(packing.token_pieces(empty, BYTE_TOKENIZER)).count() == 0
    one = packing.token_pieces(docs.limit(1), BYTE_TOKENIZER, with_ids=True).first()
    assert len(one["ids"]) == one["length"]


def test_matching_by_brute_force():
    rng = random.Random(4)
    for _ in range(2000):
        share = rng.random()
        piece = np.array([rng.random() < share for _ in range(rng.randrange(25))], dtype=bool)
        stack, matches, alone = [], [], []
        for k, x in enumerate(piece.tolist()):
            if not x:
                stack.append(k)
            elif stack:
                matches.append((stack.pop(), k))
            else:
                alone.append(k)
        a, b, left, unused = packing.match(piece)
        assert (sorted(zip(a.tolist(), b.tolist(), strict=True)), left.tolist(), sorted(unused.tolist())) == (sorted(matches), alone, sorted(stack))


def test_places_are_handed_on():
    # ranges 0 to 3: (pieces, places) left over; the nearest places come first, the smallest of a range before others
    assert packing._handed_on([(0, 2, 3), (1, 1, 0), (2, 0, 2), (3, 4, 1)]) == [(1, 0, 1, 0, 2), (3, 0, 2, 2, 1), (3, 2, 2, 0, 1)]


@pytest.mark.parametrize(("seed", "capacity"), [(0, 2048), (1, 64), (2, 2048), (3, 7), (4, 1)])
def test_best_fit(spark, seed, capacity):
    rng = random.Random(seed)
    scale = rng.choice([0.02, 0.002])
    lengths = [min(capacity, 1 + int(rng.expovariate(scale * 2048 / capacity))) for _ in range(3000)]
    df = common.cut(spark.createDataFrame(list(enumerate(lengths)), "id long, length long").repartition(6))
    rows = packing.best_fit(df, capacity).collect()
    assert sorted((r["id"], r["length"]) for r in rows) == list(enumerate(lengths))
    used = Counter()
    for r in rows:
        used[r["seq"]] += r["length"]
    assert max(used.values()) <= capacity
    # best-fit decreasing, one piece after the other
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(capacity - length)
        else:
            gaps.remove(fit)
            gaps.append(fit - length)
    assert len(used) <= len(gaps) * 1.01 + 2


def test_one_length_only(spark):
    df = common.cut(spark.range(2000).select("id", F.lit(600).cast("long").alias("length")))
    used = Counter(r["seq"] for r in packing.best_fit(df).collect())
    assert max(used.values()) == 3 and len(used) <= 2000 / 3 + 5
    assert packing.best_fit(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="1 to 500"):
        packing.best_fit(df, 500)


def test_sequences_on_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = common.cut(packing.token_pieces(docs, BYTE_TOKENIZER))
    n = packing.pack(pieces).select("sequence_id").distinct().count()
    assert n <= 1.01 * pieces.agg(F.sum("length")).first()[0] / 2048


def test_very_long_texts(spark, benchmark):
    """Texts of megabytes, on one line and on many, beside short ones."""
    item = benchmark.where("text IS NOT NULL").first()
    prose = "the quick brown fox jumps over a lazy dog by the river "
    long = {1: prose * 60_000, 2: (prose + "\n") * 60_000 + item["text"], 3: "x" * 3_000_000, 4: prose, 5: prose * 60_000}
    df = spark.createDataFrame([(k, t, "en") for k, t in long.items()], "doc_id long, text string, lang string")
    rows = {r[0]: tuple(r) for r in decontaminate.report(df, benchmark.where(F.col("item_id") == item["item_id"])).collect()}
    assert rows[2][3] == 1 and rows[1][2] == 0 and rows[3][1] == 1
    marks = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(df).collect()}
    assert marks[1] == marks[5] and marks[3][0] == f"{xxhash.xxh64_intdigest(long[3].encode(), 42):016x}"
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.report(df).collect()} == {1: 5, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {r["lang_pred"] for r in langid.report(df).collect()} == {"en"}
    assert all(0 <= r["score"] <= 1 for r in quality.report(df, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")).collect())
    sizes = packing.pack(packing.token_pieces(df, BYTE_TOKENIZER)).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert sizes == 2048


def test_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 11))
    assert public_tokenizers.path("word_bpe_49k.json") == WORD_TOKENIZER
