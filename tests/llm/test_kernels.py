import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from vocarium.llm import decontam, fastbpe, lm, ngram_join, ogg, pii, prefix_tree, quality, token_count, token_output, wordhash

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("abz  \n\t'''srtevlmd09.,!<|é ß漢字١² ​　\xa0😀AZ_-\x00\x7f")


def texts(n=2000, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "<|endoftext|>", "a<|endoftext|>'s", " " * 50 + "x", "it's we'll they'rex '' 's", "x" * 30_000]


def test_ids_equal_the_library():
    e = fastbpe.encoder(PATH)
    ids, per = e.encode(texts())
    for t, x in zip(texts(), np.split(ids, np.cumsum(per)[:-1]), strict=True):
        assert e.lib.encode(t, add_special_tokens=False).ids == x.tolist(), t
    assert e.encode([])[0].tolist() == []


def test_counts_equal_the_library():
    lib = fastbpe.encoder(PATH).lib
    got = token_count.PieceCounter(PATH).counts(texts())
    assert got.tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts()]


@pytest.mark.parametrize("bits", [2, 21])
def test_piece_cache_survives_collisions(bits):
    new = []
    cache = fastbpe.PieceCache(new.extend, bits)
    for seed in (1, 2, 1):
        part = texts(200, seed)
        small, s, e, _, _ = fastbpe.pieces(part)
        for k, n in enumerate(cache.numbers(small, s, e)):
            assert new[n] == small[s[k] : e[k]].tobytes().decode("utf-32-le")


@pytest.mark.parametrize(("keep", "pattern"), [(wordhash.BLANK_WORDS, r"[^\x20\x09-\x0D]+"), (wordhash.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(keep, pattern):
    t = texts(300)
    data = [x.encode() for x in t]
    buf, offs = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    low, s, e, first = wordhash.words(buf, offs, keep)
    for k, x in enumerate(t):
        want = re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))
        assert [low[s[i] : e[i]].tobytes().decode() for i in range(first[k], first[k + 1])] == want


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 255, 4000, 65_025, 65_026, 130_000, 254 * 255 + 10])
def test_ogg_round_trip_and_damage(size):
    rng = random.Random(size)
    payload = ogg.payload_of("".join(rng.choice("abé ") for _ in range(size)))
    media = ogg.encode(payload, {"bytes": str(size)})
    back, info = ogg.decode(media)
    assert back == payload and len(payload) % 64 == 0 and payload and info["times"][-1] == len(payload) / ogg.RATE
    for _ in range(5):
        hurt = bytearray(media)
        hurt[rng.randrange(len(hurt))] ^= 1 << rng.randrange(8)
        with pytest.raises(Exception):  # noqa: B017
            ogg.decode(bytes(hurt))
    with pytest.raises(ogg.Damaged):
        ogg.decode(media[:-1])


def test_ogg_checksum_bit_by_bit():
    r = 0
    for x in b"OggS and more":
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else r << 1 & 0xFFFFFFFF
    assert ogg.checksum(b"OggS and more") == r


def test_prefix_tree_against_brute_force():
    rng = random.Random(4)
    base = [sorted(rng.sample(range(1, 400), 30)) for _ in range(3)]
    sets = []
    for k in range(90):
        s = set(base[k % 3]) - set(rng.sample(base[k % 3], rng.randint(0, 4))) | set(rng.sample(range(1, 400), rng.randint(0, 3)))
        sets.append(np.array(sorted(s), np.uint64))
    sets += [sets[0], sets[0][:12], sets[0][:3]]
    order = np.unique(np.concatenate(sets))
    rng.shuffle(order)
    tree = prefix_tree.PrefixTree(sets, order)
    probes = [*sets[:40], np.append(sets[0], np.uint64(9999)), np.array([5000], np.uint64)]
    for p in (80, 85):
        got = {(k, int(j)) for k, found in tree.search(probes, p) for j in found}
        assert got == {(k, j) for k, s in enumerate(sets) for j, q in enumerate(probes) if 100 * len(np.intersect1d(q, s)) >= p * len(np.union1d(q, s))}


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(7)
    for n, m in ((3, 4), (700, 650), (9000, 300), (40_000, 39_000)):
        a = rng.integers(0, 1 << 62, n, np.int64).view(np.uint64)
        b = np.unique(np.concatenate((a[: m // 2], rng.integers(0, 1 << 62, m - m // 2, np.int64).view(np.uint64))))
        a = np.unique(a)
        one, two = ngram_join.signature(a), ngram_join.signature(b)
        assert ngram_join.differing(one, two) <= len(np.setxor1d(a, b))
        assert ngram_join.differing(one, one) == 0


def test_wu_manber_against_brute_force():
    rng = random.Random(6)
    vocab = [b"a", b"b", b"c", b"dd"]
    items = [(str(k), [rng.choice(vocab) for _ in range(n)]) for k, n in enumerate((0, 1, 3, 4, 6, 9))]
    for _ in range(30):
        doc = [rng.choice([*vocab, b"x"]) for _ in range(60)]
        h = decontam._hash_words(doc)
        for w in decontam.tables(items, 4):
            block = decontam.block_hashes(h) if w.block == 2 else wordhash.mix(h)
            shift = w.shift[(block >> np.uint64(64 - decontam.TABLE_BITS)).astype(np.int64)].tobytes()
            got = {(at, i) for at, names in w.search(shift, block, lambda k, d=doc: d[k], len(doc)) for i in names}
            want = {(at, i) for i, ws in items for k in range(len(ws) - w.m + 1) if min(4, len(ws)) == w.m and ws for at in range(len(doc) - w.m + 1) if doc[at : at + w.m] == ws[k : k + w.m]}
            assert got == want


def test_surrogates_are_a_permutation_and_keep_formats():
    key = b"k"
    for n in (2, 10, 1000):
        assert sorted(pii.permuted(key, "x", i, n) for i in range(n)) == list(range(n))
    t = "Mail a.b@mail5.example.com, A.B@Mail5.example.com, call +1 (743) 555-3824, ip 227.5.221.1, card 4785380592391139."
    out, seen = pii.pseudonymise(t, key)
    assert len(out) == len(t) - len("227.5.221.1") + len(next(m for k, _, m in seen if k == "ip"))
    assert [k for k, _, _ in seen] == ["email", "email", "phone", "ip", "card"] and seen[0] == seen[1]
    assert pii.card_valid(next(m for k, _, m in seen if k == "card")) and "743" not in out and "4785380592391139" not in out
    for clean in ("", "no digits at all", "card 1234567812345678", "999.1.1.1", "v1.2.3.4.5"):
        assert pii.pseudonymise(clean, key) == (clean, [])
    name, seen = pii.pseudonymise("Mrs. Anna Müller met Мария Иванова", key)
    assert seen[0][2].split()[0] in pii.FIRST_NAMES["latin", "f"] and seen[1][2].split()[0] in pii.FIRST_NAMES["cyrillic", "f"]


def test_long_runs_are_not_quadratic():
    assert pii.find("a" * 300_000 + " x@y.com")[0][2] == "email"


def test_attention_gradients_and_windows():
    rng = np.random.default_rng(0)
    sample = [rng.integers(0, 3000, 120) for _ in range(8)]
    sym = lm.Symbols(sample)
    counts = np.bincount(np.concatenate(sample), minlength=lm.VOCABULARY_SIZE)
    m = lm.Attention(sym, counts, np.zeros((lm.SYMBOLS + lm.CLASSES) * sym.cells))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.mask = m.mask.astype(np.float64)
    x, y = np.array([[1, 5, 9, 3]]), np.array([[2, 3, 4, -1]])
    g = m.gradients(x, y)

    def loss():
        z, _ = m.forward(x)
        return -sum((z - np.log(np.exp(z).sum(-1, keepdims=True)))[0, i, y[0, i]] for i in range(3)) / 3

    for k, v in m.p.items():
        at = np.unravel_index(np.argmax(np.abs(g[k])), v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        assert g[k][at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3)
        v[at] += 1e-5


def test_each_id_is_scored_once_and_shares_add_up():
    rng = np.random.default_rng(1)
    sample = [rng.integers(0, 500, 200) for _ in range(6)]
    sym = lm.Symbols(sample)
    counts = np.bincount(np.concatenate(sample), minlength=lm.VOCABULARY_SIZE)
    pairs = np.bincount(np.concatenate([sym.pairs(s, np.array([0])) for s in sample]), minlength=(lm.SYMBOLS + lm.CLASSES) * sym.cells)
    m = lm.Attention(sym, counts, pairs)
    m.train(sample, epochs=1)
    docs = [np.append(rng.integers(0, 500, n), lm.END_ID) for n in (0, 1, 30, 47, 48, 49, 200)]
    together = m.score(np.concatenate(docs), np.array([len(d) for d in docs]))
    alone = [m.score(d, np.array([len(d)]))[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)
    # over all ids, the probabilities after the end id sum to one
    first = np.array([m.score(np.array([k]), np.array([1]))[0] for k in range(0, 40)])
    assert (first < 0).all()
    z = np.power(10.0, m.follow[sym.symbol[lm.END_ID]][sym.cell] + m.rest)
    assert np.allclose(np.bincount(sym.cls, weights=z, minlength=lm.CLASSES), 1, atol=1e-3)


def test_large_logits_are_scored_as_softmax_has_them():
    rng = np.random.default_rng(2)
    sample = [rng.integers(0, 500, 200) for _ in range(4)]
    sym = lm.Symbols(sample)
    m = lm.Attention(sym, np.bincount(np.concatenate(sample), minlength=lm.VOCABULARY_SIZE), np.zeros((lm.SYMBOLS + lm.CLASSES) * sym.cells))
    m.p["B"] = rng.normal(0, 100, m.p["B"].shape).astype(np.float32)
    x, y = rng.integers(0, 500, (3, 20)), rng.integers(0, lm.CLASSES, (3, 20))
    got = m.classes(x, y)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    z = m.forward(x)[0]
    z = z - z.max(-1, keepdims=True)
    want = np.take_along_axis(z - np.log(np.exp(z).sum(-1, keepdims=True)), y[..., None], -1)[..., 0]
    near = want > -60  # beyond, exponents are clipped
    assert np.isfinite(got).all() and near.any() and np.allclose(got[near], want[near], atol=0.2)


def test_pieces_merged_by_arrays_have_the_library_s_ids():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaabehnt\u00e9=\u2013\u04490 1\n'st") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    texts += ["", " ", "a" * 300, "=" * 77, "the sea was calm", "\U0001f40b whale", "<|endoftext|> end", *(" " * k for k in range(40))]
    coder = fastbpe.merging_encoder(PATH)
    for _ in range(2):  # new pieces, then known ones
        ids, per = coder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])] == [coder.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_factorisation_machine_learns_and_scores_edges():
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "sea", "was", "calm", "whale"]) for _ in range(60)) + "." for _ in range(80)]
    bad = [" ".join(rng.choice(["THE", "SEA!!", "|", "***"]) for _ in range(60)) for _ in range(80)]
    arr, y = pa.array(good + bad), np.array([1.0] * 80 + [0.0] * 80)
    none = np.full(160, -1.0)
    r, c, v, s = quality.features(arr, none)
    fm = quality.FactorisationMachine(s.mean(0), s.std(0) + 1e-6)
    e = fm.entries(r, c, v, s)
    fm.train(*e, y)
    got = quality.scores(fm, arr, none)
    assert ((got >= 0.7) == (y == 1)).all()
    raw, _ = fm.raw(*e, 160)
    k = 3
    at = e[0] == k
    x, w, vec = e[2][at], fm.w[e[1][at]], fm.v[e[1][at]]
    slow = fm.w0 + w @ x + sum(vec[i] @ vec[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert raw[k] == pytest.approx(slow)
    assert np.isfinite(quality.scores(fm, pa.array(["", "a", "x" * 100_000]), np.full(3, -1.0))).all()
    assert quality.scores(0.5, arr, none).tolist() == [0.5] * 160


def test_shards():
    docs = [np.arange(n) for n in (1, 5, 300)]
    d = token_output.train_dictionary([x.astype("<u2").tobytes() for x in docs])
    import hashlib

    import zstandard

    press = zstandard.ZstdCompressor(dict_data=token_output._dict(d))
    blob = token_output.write_shard([(k, len(x), press.compress(token_output.serialize(x, 2))) for k, x in enumerate(docs)], 2, hashlib.sha256(d).digest())
    s = token_output.Shard(blob, d)
    assert [s.ids(k).tolist() for k in (2, 0, 1)] == [docs[k].tolist() for k in (2, 0, 1)]
    with pytest.raises(ValueError, match="dictionary"):
        token_output.Shard(blob, d + b"x")
