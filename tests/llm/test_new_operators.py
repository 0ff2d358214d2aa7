"""Best-fit packing, the Merkle manifest and phrase mining against direct rules."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from frames import awkward_texts, documents, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import bestfit, bpe, merkle, packing, phrases


def plain_best_fit(lengths, window):
    room, out = [], []
    for size in lengths:
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        if not fits:
            room.append(window)
            fits = [(window, len(room) - 1)]
        r, i = min(fits)
        out.append((i, window - r))
        room[i] -= size
    return out, len(room)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_plain_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, [65, 40, 12, 64, 30, 5][seed], 400))[::-1]
    bins, offsets, n = bestfit.best_fit_decreasing(lengths, 64)
    want, many = plain_best_fit(lengths.tolist(), 64)
    assert n == many
    # among bins of equal room either may be taken, so how full the bins are decides
    fill = np.bincount(bins, lengths, n).astype(int)
    assert sorted(fill.tolist()) == sorted(np.bincount([i for i, _ in want], lengths, n).astype(int).tolist())
    for i in range(n):
        mine = np.flatnonzero(bins == i)
        assert offsets[mine].tolist() == [0, *np.cumsum(lengths[mine])[:-1].tolist()]


def least_bins(lengths, window):
    """The fewest bins, by trying all placements."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for r in sorted(set(room)):
            if r >= lengths[i]:
                place(i + 1, [*[x for j, x in enumerate(room) if j != room.index(r)], r - lengths[i]])
        place(i + 1, [*room, window - lengths[i]])

    place(0, [])
    return best


def test_no_packing_goes_below_the_bound():
    rng = random.Random(4)
    met = 0
    for _ in range(120):
        window = rng.choice([12, 20, 31])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(1, 8))]
        bound = bestfit.lower_bound(np.bincount(lengths, minlength=window + 1), window)
        assert bound <= least_bins(lengths, window)
        met += bound == least_bins(lengths, window)
    assert met > 100
    # six pieces just over a third and three just over a half: the sum alone would allow fewer
    assert bestfit.lower_bound(np.bincount([35] * 6 + [51] * 3, minlength=101), 100) == 5 > (35 * 6 + 51 * 3) / 100 + 1


@pytest.mark.parametrize("items", [50_000, 15])
def test_packing(spark, items):
    texts = [*awkward_texts(), "a<|endoftext|> b<|endoftext|>", *(prose(400 + i, 30 + i * 7 % 90) for i in range(60)), prose(1, 900), prose(1, 900)]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in zip(ids, texts, strict=True):
        full = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(full) % 1024 or 1024
        for piece, start in enumerate([0, *range(first, len(full), 1024)]):
            part = np.array(full[start : first + 1024 * piece], "<u4").tobytes()
            want[i, piece, start, len(part) // 4, zlib.crc32(part), part] += 1
    rows = bestfit.pack_best_fit(documents(spark, texts, ids), items=items).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
        assert sum(n for _, n in parts) <= 1024
    lengths = [r.length for r in rows]
    bound = bestfit.lower_bound(np.bincount(lengths, minlength=1025))
    assert len(held) <= bound + (1 if items > 15 else 8)
    assert bestfit.pack_best_fit(documents(spark, texts, ids).limit(0)).collect() == []


def test_partitions_with_gaps_exchange(spark):
    rng = np.random.default_rng(8)
    sizes = rng.choice([260, 340, 345, 350, 500, 520, 700], 3000)
    items = spark.createDataFrame([(i, int(s), i % 60) for i, s in enumerate(sizes)], "item long, length long, part long")
    before = bestfit.certified(items, exchanges=0).select("part", "bins", "bound").distinct()
    after = bestfit.certified(items)
    assert sorted((r.item, r.length) for r in after.collect()) == list(enumerate(sizes.tolist()))
    fills = after.groupBy("part", "bin").agg(F.sum("length").alias("fill"), F.max("bins").alias("bins")).collect()
    assert max(r.fill for r in fills) <= 1024
    bins = {p: b for p, b in Counter(r.part for r in fills).items()}
    assert all(bins[r.part] == r.bins for r in fills)
    assert sum(bins.values()) <= before.agg(F.sum("bins")).first()[0]
    assert before.filter("bins < bound").count() == 0 and before.filter("bins > bound").count() > 1


def test_long_runs_of_one_piece():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("ab" * 60_000, prose(3, 40_000), "é \n" * 30_000, ("word<|endoftext|>" * 5) + " x" * 40_000):
        assert bestfit.token_ids(enc, text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(level):
    """Root, and for each leaf the list of (sibling, at its left)."""
    ways, owners = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        up, held = [], []
        for i in range(0, len(level), 2):
            run = level[i : i + 2]
            for j in range(len(run)):
                for leaf in owners[i + j]:
                    ways[leaf].append((run[1 - j], j == 1) if len(run) == 2 else None)
            up.append(H(*run))
            held.append([x for o in owners[i : i + 2] for x in o])
        level, owners = up, held
    return level[0], ways


def fold(leaf, way):
    for entry in way:
        leaf = H(leaf) if entry is None else H(entry[0], leaf) if entry[1] else H(leaf, entry[0])
    return leaf


def plain_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: H(said(r[0]), said(r[1]), said(r[2]), said(r[3] + more if r[3] is not None else None), said(r[4]))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(plain_tree([leaf(r) for r in groups[g]]))
    root, tops = plain_tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for g, (subroot, ways), top in zip(names, trees, tops, strict=True):
        for r, way in zip(groups[g], ways, strict=True):
            full = [*way, *top]
            more = 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0
            end = fold(leaf(r, more), full)
            out.append((r[0], leaf(r), subroot, root, H(*(e[0] for e in full if e)), end, end == root))
    return out


def manifest_rows(rows_of_table):
    return [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in rows_of_table.collect()]


@pytest.mark.parametrize(("tier", "shared"), [(8, 12), (2, 1), (3, 2)])
def test_manifest(spark, monkeypatch, tmp_path, tier, shared):
    monkeypatch.setattr(merkle, "TIER", tier)
    monkeypatch.setattr(merkle, "SHARED", shared)
    rng = random.Random(tier)
    rows = []
    for i in range(150):
        lang = rng.choice([None, "", "-", "=", "en", "en", "en", "é", "fr"])
        rows.append((rng.choice([None, i, i, i, 7, -i]), rng.choice([None, "s", "ü:1"]), lang, rng.choice([None, i]), rng.choice([None, "", prose(i, 3), "x"])))
    rows += [(1, "s", "en", 2, "same")] * 9 + [(None, None, "only", None, None)]
    frame = spark.createDataFrame([(*r, "k", 3, "g", "p") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, pos int, grp string, part string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest_rows(merkle.op12(spark, str(tmp_path)))
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert any(not r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(i, "s", "en", 5, "t") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(manifest_rows(merkle.op12(spark, str(tmp_path)))) == sorted(plain_manifest(rows))


def plain_phrases(rows, least, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    scored = {}
    for (lang, p), a in often.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        scored[lang, p] = (score, f[lang, p[:k]], f[lang, p[k:]])
    dropped = set()
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 80 * often[lang, p[i : i + k]]:
                    dropped.add((lang, p[i : i + k]))
    out = []
    for lang in {g for g, _ in often}:
        mine = [(-s[0], -often[lang, p], " ".join(p).encode(), s) for (g, p), s in scored.items() if g == lang and (g, p) not in dropped]
        for rank, (_, a, phrase, s) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, s[1], s[2], total[lang], s[0]))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "shards", "slots", "block"), [(3, 2000, 4, 1 << 20, 8_000_000), (2, 15, 3, 64, 300), (5, 50, 2, 4096, 2000), (4, 9, 1, 1024, 500)])
def test_phrases(spark, least, top, shards, slots, block):
    rng = random.Random(least)
    texts = [t[:3000] if t else t for t in awkward_texts()]
    texts += [" ".join(rng.choice(["the", "of", "New York City", "a\tb", "x. y", "!Zé", "AÉ", "a a a a", "\x1c", "q\x0br"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["in the long run and so on"] * 12
    langs = [rng.choice([None, "en", "en", "en", "und", "fr"]) for _ in texts]
    docs = documents(spark, texts, langs=langs).repartition(5)
    got = phrases.collocations(docs, least, top=top, shards=shards, slots=slots, block=block)
    rows = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())
    assert rows == plain_phrases(list(zip(langs, texts, strict=True)), least, top)
    assert len(rows) > 10


def test_phrases_of_nothing(spark):
    assert phrases.collocations(documents(spark).limit(0)).collect() == []
    assert phrases.collocations(documents(spark, [None, "", "once only"])).collect() == []


def test_words_are_coded_without_a_lookup_each():
    texts = [b"A b\ta.  b", b"", b"c,a"]
    words, codes = phrases._coded(texts)
    assert words[0] == b"\n" and len(words) == len(set(words))
    assert [words[c] for c in codes] == [b"a", b"b", b"a", b"\n", b"b", b"\n", b"\n", b"c", b"\n", b"a"]
    assert [c.split()[0] for c in phrases._COUNTED.split(", ")] == ["lang", "phrase", "mark", "n"]
    assert phrases._coded([])[1].tolist() == [] and phrases._coded([b" \t"])[1].tolist() == []


def test_counters_are_numbers_and_phrases_are_spelled_from_a_block():
    texts = [b"a b a b c. a b", b"b c\ta b"]
    words, codes = phrases._coded(texts)
    prints = np.frombuffer(phrases._prints("en", words), np.uint64).reshape(-1, 2)
    assert phrases._prints("en", words) != phrases._prints("fr", words)
    since = np.zeros(64, np.uint8)
    spelled = Counter()
    for length, one, two, _, n in phrases.counted(prints, codes, since, 0, 1, 3):
        for place, many in zip(phrases._places(one, two & phrases._REST, length, prints, codes), n.tolist(), strict=True):
            spelled[b" ".join(words[c] for c in codes[place : place + length])] += many
    assert spelled == {
        b"a": 4, b"b": 5, b"c": 2, b"a b": 4, b"b a": 1, b"b c": 2, b"c a": 1, b"a b a": 1, b"b a b": 1, b"a b c": 1, b"b c a": 1, b"c a b": 1,
    }
    with pytest.raises(RuntimeError):
        phrases._places(one[:1] + np.uint64(1), two[:1] & phrases._REST, 3, prints, codes)
    assert {c.split()[1] for c in phrases._COUNTERS.split(", ")} == {"long"}


def test_each_distinct_chunk_of_a_part_is_looked_up_once(monkeypatch):
    chunks = packing._Chunks(public_tokenizers.path(packing.VOCABULARY))
    asked = []
    learn = chunks._learn
    monkeypatch.setattr(chunks, "_learn", lambda seen: asked.extend(seen) or learn(seen))
    texts = ["one two\none", "", "two  ½ x² " + "y" * 60, "one"] * 3
    got = [np.frombuffer(i, chunks.dtype).tolist() for i in chunks.encode(texts)]
    assert got == [chunks.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) and "y" * 60 not in chunks.known
    assert chunks.encode([]) == []
