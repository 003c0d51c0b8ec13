"""Nulls, empty and long texts, ties and repeats, empty tables, clashing columns; and brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vocarium.llm import components, decontam, fastbpe, lm, ngram_join, ogg, packing, pii, quality, shared, token_count, token_output, url_filter

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, token string, row string, score double, id string"
LOW = {c: c + 32 for c in range(65, 91)}


def row(k, t):
    return (k, t, None, None, None, 1, "x", "y", 0.0, "z")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(0, None), row(1, ""), row(2, "Hello"), row(3, "hello"), row(4, "w " * 30_000), row(5, "a b c d e f"), row(5, "a b c d e f"), row(None, "null id here"), row(7, "x" * 50_000), row(8, " \t\n")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(t):
    return (t or "").translate(LOW)


def sets(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", plain(t))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_join_edges(docs, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs, 4, 85).collect()}
    assert got == {(0, 0, 0), (1, 0, 1), (2, 1, 2), (3, 1, 2), (4, 1, 4), (5, 3, 5), (None, 1, None), (7, 1, 7), (8, 0, 8)}
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_join_against_brute_force(spark):
    rng, words, rows = random.Random(8), [f"w{k}" for k in range(200)], []
    for _ in range(15):
        base = [rng.choice(words) for _ in range(rng.choice([6, 20, 80]))]
        for _ in range(rng.randint(1, 10)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    s = {k: sets(t, 4) for k, t in rows}
    root = {k: k for k in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in range(a):
            if 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(k, find(k)) for k in s}


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 12)] + [(20, 30), (30, 20)], "a long, b long")
    assert {(r["id"], r["component"]) for r in components.components(e).collect()} == {(k, 1) for k in range(1, 13)} | {(20, 20), (30, 20)}


def test_decontamination(spark, docs, empty):
    text = "One two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, text), (10, "a b c"), (2, "a b c"), (3, None), (4, "")], "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([row(9, "zero " + text.upper() + " twelve"), row(11, "x y a-b-c z")], SCHEMA))
    for block in (2_000_000, 5):
        decontam.BLOCK_WORDS, old = block, decontam.BLOCK_WORDS
        try:
            got = {r["doc_id"]: r for r in decontam.decontaminate(more, bench).collect()}
            assert decontam.clean(more, bench).count() == more.count() - 4
            assert decontam.clean(more, bench).columns == more.columns
        finally:
            decontam.BLOCK_WORDS = old
        assert (got[9]["n_words"], got[9]["n_hit"], got[9]["n_items"]) == (13, 11, 1)
        assert got[11]["n_hit"] == 3 and got[11]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest()
        assert got[0]["n_words"] == 0 and not got[1]["contaminated"] and got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
        assert got[5]["n_hit"] == 3
    assert decontam.decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.decontaminate(docs, bench.limit(0)).collect())


def test_media(docs, empty):
    got = ogg.media_features(ogg.media_column(docs)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[0]["payload_bytes"] == 64 == by[1]["payload_bytes"] and by[0]["media_sha256"] == by[1]["media_sha256"]
    p = b"hello" + bytes(59)
    assert by[3]["payload_sha256"] == hashlib.sha256(p).hexdigest() and by[3]["tail_crc32"] == zlib.crc32(p) and by[3]["n_bytes"] == 5
    assert ogg.media_features(ogg.media_column(empty)).count() == 0


URLS = [
    (1, "http://a.example.net/en/1"), (2, "http://example.net"), (3, "https://x.example.com/de/5?q=1"), (4, "http://o.org/fr/"), (5, "http://B.NET/x"), (6, None), (7, "no scheme"),
    (8, "http://notexample.com/de/1"), (9, "http://example.net/en"), (10, ""), (11, "http://net/?a"), (11, "http://net/?a"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, 1, "x") for k, u in URLS], "page_id long, url string, length int, host string")
    bad = [("http://casino-%d-x.example.com/p%d" % (k, k), 1) for k in range(60)]
    good = [("http://plain%d.example.com/p%d" % (k, k), 0) for k in range(140)]
    model = url_filter.train(spark.createDataFrame(bad + good, "url string, label int"))
    got = url_filter.judge(pages, model)
    r = {x["page_id"]: x for x in got.collect()}
    assert got.count() == len(URLS)
    assert (r[1]["rule"], r[1]["verdict"]) == ("example.net/en/", "allow") and (r[3]["rule"], r[3]["verdict"]) == ("example.com/de/", "block")
    assert r[2]["rule"] is None and r[2]["path"] == "" and r[4]["rule"] == "org/fr/" and (r[5]["host"], r[5]["rule"]) == ("b.net", "net/")
    assert (r[6]["host"], r[6]["path"], r[6]["rule"]) == ("", "", None) == (r[7]["host"], r[7]["path"], r[7]["rule"]) and r[8]["rule"] is None and r[9]["rule"] == "net/"
    seen = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(bad[:20] + good[:20])], "page_id long, url string")
    assert [x["verdict"] for x in url_filter.judge(seen, model).orderBy("page_id").collect()] == ["block"] * 20 + ["allow"] * 20
    none = url_filter.train(spark.createDataFrame([], "url string, label int"))
    assert {x["verdict"] for x in url_filter.judge(pages.where("page_id in (6, 8)"), none).collect()} == {"allow"}


def test_suffix_statistics_cover_every_url_and_suffix(spark):
    rows = [(f"http://h{k}.s{k % 500}/x", int(k % 500 % 3 == 0 and k % 2)) for k in range(500 * 21)] + [("http://h.rare/x", 1)] * 19 + [("no scheme", 0)] * 20
    df = spark.createDataFrame(rows, "url string, label int")
    rates, rate = url_filter.suffix_rates(df)
    by = {}
    for u, y in rows:
        by.setdefault(u.split("://")[1].split("/")[0].split(".")[-1] if "://" in u else "", []).append(y)
    assert rate == sum(y for _, y in rows) / len(rows)
    want = {k: (sum(y) + 20 * rate) / (len(y) + 20) for k, y in by.items() if len(y) >= 20}
    got = {r["suffix"]: r["suffix_rate"] for r in rates.collect()}
    assert got.keys() == want.keys() and len(got) == 501 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    hosts = spark.createDataFrame([("a.s3",)] * 3 + [("b.s4",), ("rare",), ("",), ("c.none",)], "host string")
    small, large = (sorted((r["host"], r["suffix_rate"]) for r in url_filter.with_suffix_rate(hosts, F.col("host"), rates, rate, chars).collect()) for chars in (url_filter.SUFFIX_CHARS, 0))
    assert small == large and [h for h, _ in small] == ["", "a.s3", "a.s3", "a.s3", "b.s4", "c.none", "rare"]
    assert small[0][1] == got[""] and small[1][1] == got["s3"] and small[5][1] == small[6][1] == rate
    none, zero = url_filter.suffix_rates(df.limit(0))
    assert zero == 0.0 and none.count() == 0


def test_pii(spark, docs, empty):
    names = [f"Mrs. {a}{b} Zz" for a in "BCDFGHKLM" for b in ("ova", "una", "ira", "ela", "ota")]
    people = spark.createDataFrame([row(100 + k, f"Seen: {n}.") for k, n in enumerate(names)], SCHEMA)
    more = docs.unionByName(people).unionByName(spark.createDataFrame([row(50, "to a@b.com and c@d.com"), row(51, "from a@b.com"), row(51, "from a@b.com")], SCHEMA))
    out = pii.replace_pii(more, b"key")
    got = out.collect()
    assert out.columns == [*more.columns, "pii_types", "pii_count"] and len(got) == more.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["text"] is None and by[1]["text"] == "" and by[4]["text"] == "w " * 30_000 and by[5]["pii_count"] == 0
    first = by[50]["text"].split()[1]
    assert by[51]["text"] == f"from {first}" and first != "a@b.com" and by[50]["pii_types"] == ["email"]
    made = [by[100 + k]["text"] for k in range(len(names))]
    assert len(set(made)) == len(names)  # 45 names over 20 first names: collisions had to draw again
    assert pii.replace_pii(empty, b"key").count() == 0
    assert pii.replace_pii(out, b"other").columns == out.columns


def test_token_files(spark, docs, empty):
    got = token_output.read_tokens(spark, token_output.write_tokens(docs, shared.shared_dir(spark), PATH, 2)).orderBy("start").collect()
    lib = fastbpe.encoder(PATH).lib
    at = 0
    assert [r["id"] for r in got] == [None, 0, 1, 2, 3, 4, 5, 5, 7, 8]
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        ids = [*lib.encode(text[r["id"]], add_special_tokens=False).ids, 2]
        assert r["start"] == at and r["n_tokens"] == len(ids) and r["ids"] == b"".join(i.to_bytes(4, "little") for i in ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += len(ids)
    assert token_output.read_tokens(spark, token_output.write_tokens(empty, shared.shared_dir(spark), PATH, 2)).count() == 0


def test_packing(docs, empty):
    pieces = packing.pack(docs, PATH, 1, window=512)
    got = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    seq, off = 0, 0
    for r in got:
        assert (r["sequence_id"], r["offset"]) == (seq, off) and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        off += r["length"]
        assert off <= 512
        seq, off = (seq + 1, 0) if off == 512 else (seq, off)
    sums = Counter()
    for r in got:
        sums[r["doc_id"]] += r["length"]
    assert sums[0] == 1 and sums[5] == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 5)
    full = packing.sequences(pieces, 0, 512).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) in (512, r["n_ids"]) for r in full)
    assert b"".join(int(i).to_bytes(4, "little") for i in full[0]["ids"]) == b"".join(r["ids"] for r in got if r["sequence_id"] == 0)
    assert packing.pack(empty, PATH, 1).count() == 0


def test_token_counts(docs, empty):
    lib = fastbpe.encoder(PATH).lib
    got = token_count.token_counts(docs, PATH).collect()
    want = sorted((len((r["text"] or "").encode()), len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_count.token_counts(empty, PATH).count() == 0


def test_quality(spark, docs, empty):
    train = [row(k, "the sea was calm " * 20 if k % 2 else "THE SEA!! | *** " * 20) for k in range(100, 160)]
    more = docs.unionByName(spark.createDataFrame(train, SCHEMA))
    labels = spark.createDataFrame([(k, k % 2) for k in range(100, 160)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(more, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(more, model).collect()}
    assert all((got[k] >= 0.7) == (k % 2 == 1) for k in range(100, 160)) and all(0 <= x <= 1 for x in got.values())
    assert quality.score(empty, model).count() == 0 and quality.with_score(more, model).count() == more.count()
    assert quality.train(empty, labels) == 0.5 and quality.train(more, labels.where("quality = 1")) == 1.0


def test_language_model(docs, empty):
    got = lm.lm_scores(docs, PATH).collect()
    rows = docs.collect()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", plain(t)), None]
    c = Counter(w for r in rows if not held(r["doc_id"]) for w in toks(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted((len(toks(r["text"])), sum(c[w] > 0 for w in toks(r["text"])), round(sum(log10((c[w] + 1) / (n + v + 1)) for w in toks(r["text"])), 4), held(r["doc_id"])) for r in rows)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 4), r["held_out"]) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm.lm_scores(empty, PATH).count() == 0


def test_rare_words_meet_by_a_join(docs, monkeypatch):
    whole = sorted((r["n_known"], round(r["base_score"], 4)) for r in lm.lm_scores(docs, PATH).collect())
    monkeypatch.setattr(lm, "HOT_WORDS", 2)
    assert sorted((r["n_known"], round(r["base_score"], 4)) for r in lm.lm_scores(docs, PATH).collect()) == whole


def test_language_model_learns_from_every_training_document(spark, monkeypatch):
    long_ = " ".join(f"w{k % 900}" for k in range(3000))
    rows = [(k, f"some words of document {k}") for k in range(60)] + [(100, long_)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned, train = [], lm.train_everywhere
    monkeypatch.setattr(lm, "train_everywhere", lambda *a: learned.append(train(*a)))
    lm.lm_scores(df, PATH, held=7).collect()  # no document is held out
    lib = fastbpe.encoder(PATH).lib
    assert learned == [sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)]
    few = lm.encoded(df.where("doc_id < 10").select("text"), PATH)
    sample = [r["ids"] for r in few.collect()]
    sym = lm.Symbols([np.frombuffer(x, "<u2").astype(int) for x in sample])
    models = [lm.Attention(sym, np.zeros(lm.VOCABULARY_SIZE), np.zeros((lm.SYMBOLS + lm.CLASSES) * sym.cells)) for _ in range(2)]
    train(models[0], few)
    train(models[1], few.unionAll(lm.encoded(df.where("doc_id = 100").select("text"), PATH)))
    assert abs(models[0].p["E"] - models[1].p["E"]).max() > 0


def test_pii_gives_a_name_one_surrogate_whatever_the_title(spark):
    first = [f"{a}{b}" for a in "BCDFGHKLM" for b in ("ova", "una", "ira", "ela", "ota")]
    texts = [f"{t} {n} Zz" for n in first for t in ("Mr", "Ms", "Dr")]
    out = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"key")
    made = {r["doc_id"]: r["text"].split(" ", 1)[1] for r in out.collect()}
    by_name = [{made[3 * k + j] for j in range(3)} for k in range(len(first))]
    assert all(len(x) == 1 for x in by_name)
    assert len(set.union(*by_name)) == len(first) and not set.union(*by_name) & {f"{n} Zz" for n in first}


def test_components_that_are_not_done_are_an_error(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 12)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(e, most_rounds=1)


def test_every_link_inside_a_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 8)  # several tiles in the large group
    monkeypatch.setattr(ngram_join, "BLOCK", 5)  # several blocks of one n-gram
    rng = random.Random(3)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(t)))
    rows += [(60 + k, rows[3 * k][1]) for k in range(8)] + [(80, "quite another text of a few words"), (81, ""), (None, rows[0][1])]
    s = {k: sets(t, 4) for k, t in rows if k is not None}
    low = {}
    for k in sorted(s):
        low.setdefault(frozenset(s[k]), k)
    linked = lambda a, b: s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])
    reps = [k for f, k in low.items() if f]
    links, members = ngram_join.ngram_jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    got = {(r["a"], r["b"]) for r in links.collect()}
    want = {(a, b) for a in reps for b in reps if a < b and linked(a, b)}
    assert got == want and 100 < len(want) < len(reps) * (len(reps) - 1) // 2
    by = {r["doc_id"]: r for r in members.collect()}
    assert len(by) == len(rows) and by[None]["n_links"] == 0 == by[81]["n_links"] and by[None]["component_id"] is None
    assert all(by[k]["n_links"] == sum(k != j and bool(linked(k, j)) for j in s) for k in s)
    assert all(by[k]["class_id"] == (low[frozenset(s[k])] if s[k] else None) for k in s)


@pytest.mark.parametrize(("block", "salt"), [(3, 1 << 16), (2, 4)])
def test_hot_tokens_join_across_blocks(spark, monkeypatch, block, salt):
    """Documents of one passage and a few words of their own: all share n-grams, only some link."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", salt)
    rng, rows = random.Random(11), []
    passage = [f"p{k}" for k in range(40)]
    for g in range(12):
        own = [f"g{g}_{k}" for k in range(rng.randint(2, 14))]
        for _ in range(rng.randint(1, 5)):
            t = passage + own
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = f"z{len(rows)}"
            rows.append((len(rows), " ".join(t)))
    s = {k: sets(t, 4) for k, t in rows}
    links = {(a, b) for a in s for b in s if a != b and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])}
    least = {k: k for k in s}
    for _ in s:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert 3 < len(set(least.values())) < len(s) - 5
    out = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in out.collect()} == {(k, least[k], sum(a == k for a, _ in links)) for k in s}


def test_pii_of_letters_that_no_alphabet_holds(spark):
    """Names that can't be permuted get a defined surrogate; distinct ones stay distinct, surnames keep theirs."""
    names = ["Øø", "Åå", "Ðð", "Þþ", "Æø"]
    texts = [f"I met Mr {n} today." for n in names] + [f"Frau {n}" for n in names] + ["mail 用户@example.org now"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(rows, b"key").collect()}
    made = [got[k].split()[3] for k in range(5)]
    assert len(set(made)) == 5 and not set(made) & set(names)
    assert made == [got[5 + k].split()[1] for k in range(5)]
    assert "用" not in got[10] and got[10].endswith(".org now")


@pytest.mark.parametrize("sent", [0, 100_000])
def test_pii_keeps_surnames_and_values_apart(spark, monkeypatch, sent):
    """Many first names on one surname: brute force over all that was written."""
    monkeypatch.setattr(pii, "SENT_VALUES", sent)
    first = ["Anna", "John", "Kim", "Bo", "Maria", "Lee", "Paul", "Zed", "Uma", "Ray", "Sol"]
    texts = [f"{t} {f} {s}" for f in first for s in ("Smith", "Jones") for t in ("Dr", "Prof")] + ["Mr Smith", "Mrs Jones", None, ""] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(df, b"key").collect()}
    by = {}
    for k, t in enumerate(texts):
        assert (out[k] is None) == (t is None) and (t != "" or out[k] == "")
        if t:
            by.setdefault(t.split(" ", 1)[1], set()).add(out[k].split(" ", 1)[1])
    assert all(len(v) == 1 for v in by.values())
    assert len(set.union(*by.values())) == len(by) and not set.union(*by.values()) & set(by)
    for s in ("Smith", "Jones"):
        (alone,) = by[s]
        assert all(next(iter(by[f"{f} {s}"])).endswith(" " + alone) for f in first[:5])


def test_packed_ids_are_the_library_s(docs):
    lib = fastbpe.encoder(PATH).lib
    pieces = packing.pack(docs, PATH, 1, window=512).collect()
    want = Counter(zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    whole, part = Counter(), b""
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["start"] * 4 == len(part)
        part += r["ids"]
        if len(part) == 4 * r["doc_tokens"]:
            whole[zlib.crc32(part)] += 1
            part = b""
    assert whole == want and not part


def test_media_that_cannot_be_read(spark):
    good = ogg.encode(ogg.payload_of("abc"), {"bytes": "3"})
    hurt = good[:40] + bytes([good[40] ^ 1]) + good[41:]
    rows = spark.createDataFrame([(1, good), (2, None), (3, hurt), (4, good[:-1]), (5, b""), (6, b"x" * 99)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in ogg.media_features(rows).collect()}
    assert got[1]["error"] is None and got[1]["n_bytes"] == 3 and got[1]["feature"].startswith("pages=")
    assert all(got[k]["error"] and got[k]["payload_sha256"] is None and got[k]["feature"] is None for k in range(2, 7))
    assert got[2]["media_bytes"] is None and got[5]["media_bytes"] == 0


def test_feature_strings_against_plain_loops(docs):
    for r in ogg.media_features(ogg.media_column(docs)).collect():
        raw = (next(d["text"] for d in docs.collect() if d["doc_id"] == r["doc_id"]) or "").encode()
        x = [v - 128 for v in raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))]
        told = dict(p.split("=") for p in r["feature"].split(";"))
        assert int(told["peak"]) == max(map(abs, x)) and int(told["power"]) == sum(v * v for v in x)
        assert int(told["cross"]) == sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) and int(told["us"]) == round(len(x) / 8000 * 1e6)
