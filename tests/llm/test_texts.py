"""Operators on documents against direct rules on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from frames import awkward_texts, by_id, documents, prose
from tokenizers import Tokenizer

from parlance.llm import bpe, language, packing, quality, repeats, secrets, sharding, simhash


def brute_repeats(texts, span):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - span + 1):
            seen[raw[i : i + span]] = seen.get(raw[i : i + span], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - span + 1):
            if seen[raw[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), kept))
    return out


@pytest.mark.parametrize(("span", "gram", "wide"), [(400, 50, 20_000), (60, 12, 20_000), (60, 12, 1)])
def test_repeats(spark, span, gram, wide):
    texts = [t[:4000] if t else t for t in awkward_texts()]
    rng = np.random.default_rng(span)
    core = prose(50, 40)
    texts += [prose(100 + i, 6) + core[int(rng.integers(0, 20)) :] + prose(200 + i % 3, 12) for i in range(20)]
    want = brute_repeats(texts, span)
    docs = documents(spark, texts)
    got = {bytes(r.key): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.cut_texts(docs, span, gram, wide).collect()}
    for text, expected in zip(texts, want, strict=True):
        assert got[hashlib.sha256((text or "").encode()).digest()[:16]] == expected, text and text[:60]
    cut = by_id(repeats.without_repeats(docs, span, gram, wide))
    for i, (text, expected) in enumerate(zip(texts, want, strict=True)):
        assert cut[i].text == (None if text is None else expected[3].decode("utf-8", "ignore"))
        assert (cut[i].key, cut[i]._key, cut[i]._kept, cut[i].row) == ("k", "u", "w", "r")


def test_places_depend_on_the_string_alone():
    core = prose(9, 200).encode()
    for before, after in ((b"", b"zz"), (prose(10, 90).encode(), b""), (b"q" * 977, prose(11, 50).encode())):
        raw = before + core + after
        at, _ = repeats.chosen(raw)
        alone, _ = repeats.chosen(core)
        inside = {int(p) - len(before) for p in at}
        assert set(alone.tolist()) <= inside
    long_text = ("".join(chr(97 + i % 26) for i in range(5000))).encode()
    assert len(repeats.chosen(long_text)[0]) > 0


def test_repeats_over_segments(monkeypatch):
    raw = prose(12, 3000).encode()
    whole = repeats.chosen(raw)
    monkeypatch.setattr(repeats, "_SEGMENT", 1000)
    parts = repeats.chosen(raw)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(codes, close):
    root = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if close(codes[i], codes[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_simhash(spark):
    base = prose(20, 400)
    texts = awkward_texts()[:-11] + [base, base + " x", base.upper(), base + " x y", prose(21, 4), prose(21, 4), None, ""]
    ids = [i * 7 % 101 for i in range(len(texts))]
    codes = [brute_print(t) for t in texts]
    root = brute_groups(codes, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {r: min(i for i, q in zip(ids, root, strict=True) if q == r) for r in set(root)}
    got = by_id(simhash.near_duplicates(documents(spark, texts, ids)))
    for i, code, r in zip(ids, codes, root, strict=True):
        assert got[i].fp % (1 << 64) == code
        assert got[i].component_id == least[r]


@pytest.mark.parametrize("crowded", [512, 3])
def test_simhash_links_of_crowded_keys(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "WIDE", crowded)
    rng = np.random.default_rng(3)
    codes = {int(rng.integers(0, 2**63))}
    for _ in range(120):
        code = int(rng.choice(list(codes)))
        for bit in rng.integers(0, 64, 2):
            code ^= 1 << int(bit)
        codes.add(code)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.near_links(spark.createDataFrame([(c,) for c in signed], "fp long"))
    found = [(signed.index(r.a), signed.index(r.b)) for r in links.collect()]
    root = list(range(len(codes)))
    for a, b in found:
        assert (codes[a] ^ codes[b]).bit_count() > 0
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    assert root == brute_groups(codes, lambda a, b: (a ^ b).bit_count() <= 2)


def test_bpe(spark):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    texts = [*awkward_texts(), "word " * 20_000 + "x" * 70_000 + "\n" * 500 + "don't 12345 ?!" * 9000]
    got = by_id(bpe.digests(documents(spark, texts)))
    for i, text in enumerate(texts):
        ids = enc.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = by_id(bpe.decode_ids(bpe.encode_documents(documents(spark, texts))))
    assert all(bytes(back[i].bytes) == (t or "").encode() for i, t in enumerate(texts))


def test_bpe_runs_without_a_boundary():
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    text = "start " + " " * 1_200_000 + "end"
    assert enc.decode(bpe.encode(enc, text)) == text
    text = "start" + " " * 300_000 + "end"
    assert bpe.encode(enc, text) == enc.encode_ordinary(text)


def check_packed(pieces, texts, ids=None, window=2048):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in zip(ids or range(len(texts)), texts, strict=True)}
    of_doc, of_sequence = {}, {}
    for p in pieces:
        of_doc.setdefault(p.doc_id, []).append(p)
        of_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(of_doc) == set(want)
    for i, parts in of_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            part = np.array(want[i][p.start : p.start + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(want[i]), zlib.crc32(part)) and bytes(p.ids) == part
            at += p.length
        assert at == len(want[i])
    padding = 0
    for parts in of_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_packing(spark):
    texts = [*awkward_texts(), *(prose(300 + i, 20 + 13 * i) for i in range(60))]
    assert check_packed(packing.pack(documents(spark, texts)).collect(), texts) == 0


def test_packing_of_equal_lengths(spark):
    texts = ["one two three"] * 500
    pieces = packing.pack(documents(spark, texts)).collect()
    assert check_packed(pieces, texts) == 0


def test_combinations_fill_a_window():
    counts = np.bincount(np.random.default_rng(0).integers(1, 2048, 3000), minlength=2048)
    combos = packing.combinations(counts)
    assert (combos.sum(axis=1) == 2048).all() and len(combos) > 500
    made = packing.plan(counts)
    assert made.placed.sum() > 1500


def test_secrets(spark):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    texts = awkward_texts()
    docs = documents(spark, texts).select("doc_id", "text")
    _, findings = secrets.advance(docs)
    got = by_id(secrets.located(docs, findings))
    masked = by_id(secrets.mask(docs, findings))
    total = 0
    for i, text in enumerate(texts):
        text = text or ""
        want = [(m.start(), 0, "assign", m.end()) for m in pattern.finditer(text) if len(m.group(2)) >= 8]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
        assert [tuple(s) for s in got[i].spans or []] == sorted(want)
        total += len(want)
        out, at = "", 0
        merged = []
        for start, _, _, end in sorted(want):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        for start, end in merged:
            out, at = out + text[at:start] + "[SECRET]", end
        assert masked[i].text == (None if texts[i] is None else out + text[at:])
    assert total >= 6


def test_ledger_scans_only_what_is_new(spark):
    first = documents(spark, ["token=aaaaaaaaaaaa", "plain"]).select("doc_id", "text")
    ledger, findings = secrets.advance(first)
    second = documents(spark, ["token=aaaaaaaaaaaa", "plain", "secret: bbbbbbbbbbbb", "secret: bbbbbbbbbbbb"]).select("doc_id", "text")
    new = secrets.unscanned(second, ledger)
    assert [r.text for r in new.collect()] == ["secret: bbbbbbbbbbbb"]
    ledger, findings = secrets.advance(second, ledger, findings)
    assert ledger.count() == 3 and findings.count() == 2
    assert secrets.unscanned(second, ledger).count() == 0
    assert secrets.unscanned(second, ledger, rule_version=2).count() == 3
    spans = by_id(secrets.located(second, findings))
    assert [bool(spans[i].spans) for i in range(4)] == [True, False, True, True]


def test_sharding(spark):
    texts = awkward_texts() + [prose(400 + i, 30) for i in range(300)]
    docs = documents(spark, texts)
    records = sharding.sized(docs)
    sizes = sharding.slot_sizes(records)
    first = sharding.first_map(sizes)
    placed = sharding.placed(records, first.select("vslot", "shard")).collect()
    assert len(placed) == len(texts)
    for r in placed:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for shard in range(8):
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(sum(r.shard == shard for r in placed)))
    slots = {r.vslot: r.shard for r in first.collect()}
    assert len(slots) == sharding.SLOTS
    second = sharding.rebalanced(first, sizes, 9)
    moved = {r.vslot: r.shard for r in second.collect()}
    assert {r.version for r in second.collect()} == {2}
    loads = {s: sum(r.bytes for r in sizes.collect() if moved[r.vslot] == s) for s in range(9)}
    biggest = max(r.bytes for r in sizes.collect())
    assert max(loads.values()) <= sum(loads.values()) / 9 + biggest
    assert sum(slots[v] != s for v, s in moved.items()) < sharding.SLOTS / 2


def test_near_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    records = sharding.sized(docs)
    placed = sharding.placed(records, sharding.first_map(sharding.slot_sizes(records)).select("vslot", "shard"))
    loads = [r[0] for r in placed.groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.01 * sum(loads) / 8


def test_written_shards(spark, tmp_path):
    docs = documents(spark).drop("shard")
    slot_map = sharding.save_map(sharding.first_map(sharding.slot_sizes(sharding.sized(docs))))
    sharding.write_shards(docs, slot_map, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(awkward_texts())


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.op4(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_cases(spark):
    texts = ["the cat and the dog", "le chat et le chien", None, "", "123 !!!", "the the the", "\U0001f600"]
    docs = documents(spark, texts, langs=["en", "fr", "en", "fr", "en", None, None])
    learned = language.profiles(docs)
    got = by_id(language.identify(docs, learned))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 6))
    nothing = by_id(language.identify(docs, learned.limit(0)))
    assert {r.lang_pred for r in nothing.values()} == {"und"}
    grams, counts = language.ngrams("Ab a")
    assert counts.sum() == 3 + 5 + 3  # letters; pairs of ' ab a '; triples ' ab', 'ab ', ' a '


def test_quality_held_out(spark):
    scores = quality.op2(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = scores.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() > 0.93
    assert scores.score.between(0, 1).all() and len(scores) == 1000


def test_quality_cases(spark):
    texts = awkward_texts()
    stats = quality.with_statistics(documents(spark, texts))
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))] + [(3, None)], "doc_id long, quality int")
    trees = quality.learn(stats, labels)
    got = quality.scored(stats, trees).toPandas()
    assert len(got) == len(texts) and got.score.between(0, 1).all()
    none = quality.learn(stats, labels.limit(0))
    assert set(quality.scored(stats, none).toPandas().score) == {0.5}
    one = quality.fit(np.zeros((5, 3), np.float32), np.ones(5))
    assert (one.score(np.zeros((2, 3))) > 0.9).all()


def test_trees_follow_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality.fit(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_trees_equal_a_walk_and_an_exhaustive_split():
    """Flat arrays against a walk node by node, and the first split against all features and limits."""
    rng = np.random.default_rng(3)
    x, least = rng.normal(size=(300, 5)).astype(np.float32), 20
    y = (x[:, 2] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    trees = quality.fit(x, y, trees=6, depth=3, bins=16, least=least)
    for row, score in zip(x, trees.score(x), strict=True):
        total = trees.start
        for feature, limit, value in zip(trees.feature, trees.limit, trees.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += value[node - len(feature)]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12
    grad, hess = y.mean() - y, np.full(300, y.mean() * (1 - y.mean()))

    def gain(f, limit):
        left = x[:, f] <= limit
        if left.sum() < least or (~left).sum() < least:
            return 0.0
        part = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + 1)
        return part(left) + part(~left) - part(np.ones(300, bool))

    best = max(gain(f, limit) for f in range(5) for limit in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])))
    assert best > 0 and abs(gain(trees.feature[0, 0], trees.limit[0, 0]) - best) < 1e-9


def test_language_equals_a_plain_out_of_place_distance(spark):
    """Profiles and predictions against counts and ranks written out with strings."""
    texts = ["the cat and the dog sat", "a dog and a hat, that is that", "le chat et le chien", "un chien est la et le chat aussi", "das ist ein Hund und die Katze"]
    langs = ["en", "en", "fr", "fr", "de"]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 0][: len(texts)]
    size = 25

    def counted(text):
        line = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        grams = [c for c in line if c != " "] + [line[i : i + 2] for i in range(len(line) - 1)]
        return Counter(grams + [line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " "])

    def ranked(counts):
        code = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(reversed(g)))
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]

    plain = {g: ranked(sum((counted(t) for t, x in zip(texts, langs, strict=True) if x == g), Counter())) for g in set(langs)}
    asked = [*texts, "the hat", "le", "Hund", "dog chat und"]
    learned = language.profiles(documents(spark, texts, ids, langs), size=size)
    got = by_id(language.identify(documents(spark, asked), learned, size))
    for i, text in enumerate(asked):
        top = ranked(counted(text))
        costs = {g: sum(abs(p.index(x) - k) if x in p else size for k, x in enumerate(top)) for g, p in plain.items()}
        best = min(sorted(costs), key=costs.get)
        assert got[i].lang_pred == best and abs(got[i].score - (1 - costs[best] / (size * len(top)))) < 1e-12


@pytest.mark.parametrize("name", ["simhash", "bpe", "packing", "secrets", "sharding", "language", "quality", "repeats"])
def test_empty_table(spark, name):
    docs = documents(spark, [])
    frame = {
        "simhash": lambda: simhash.near_duplicates(docs),
        "bpe": lambda: bpe.digests(docs),
        "packing": lambda: packing.pack(docs),
        "secrets": lambda: secrets.mask(docs, secrets.advance(docs)[1]),
        "sharding": lambda: sharding.placed(sharding.sized(docs), sharding.first_map(sharding.slot_sizes(sharding.sized(docs))).select("vslot", "shard")),
        "language": lambda: language.identify(docs, language.profiles(docs)),
        "quality": lambda: quality.with_statistics(docs),
        "repeats": lambda: repeats.without_repeats(docs),
    }[name]()
    assert frame.collect() == []


def test_null_and_repeated_ids(spark):
    texts, ids = ["same text here now"] * 3 + ["other words are here", None], [None, 4, 4, None, None]
    docs = documents(spark, texts, ids)
    near = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in near if r.component_id is not None) == [(False, 4), (False, 4), (True, 4)]
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0) and sum(p.start == 0 for p in pieces) == 5
    assert bpe.digests(docs).count() == 5
    records = sharding.sized(docs)
    assert sharding.placed(records, sharding.first_map(sharding.slot_sizes(records)).select("vslot", "shard")).count() == 5
    assert repeats.without_repeats(docs).count() == 5


def test_chunks_follow_the_tokenizer(spark):
    """All texts of the data, random words and awkward chunks, through both ways of a chunk."""
    path = public_tokenizers.path(packing.VOCABULARY)
    tok, chunks = Tokenizer.from_file(path), packing._Chunks(path)
    assert chunks.merged is not None
    rng = np.random.default_rng(7)
    letters = list("etaoinshrdlucmfwypvbgkjqxzéèñüöäßçœăžİŉſK")
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(20_000)]
    odd = ["it's <|endoftext|>x 12 ΣΑΣ\tb c é ́ İstanbul don't A, B. c; D!! <|ENDOFTEXT|> ﬁne ①② ½ é क़ 가각", "x1. 1. 2, .. a.. \r\n x\x1cy \x85z  q ªº µ", "", " "]
    odd += [t or "" for t in awkward_texts()] + [" ".join(words[i : i + 50]) + ". " + words[i].title() + ", " + words[i].upper() for i in range(0, len(words), 50)]
    odd += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, ids in zip(odd, chunks.encode(odd), strict=True):
        assert np.frombuffer(ids, chunks.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text[:80]


def test_chunks_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "PART", 200)
    path = public_tokenizers.path(packing.VOCABULARY)
    tok, chunks = Tokenizer.from_file(path), packing._Chunks(path)
    texts = [prose(i, 60) for i in range(30)]
    for text, ids in zip(texts, chunks.encode(texts), strict=True):
        assert np.frombuffer(ids, chunks.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(chunks.known) <= 40 + 200
