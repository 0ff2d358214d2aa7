"""Sub-word pieces: the walk in memory, the join, and the rule written out."""

import random

from parlance.operators.casing import Pieces, wordpiece_coverage


def plain(word, vocab, max_chars):
    out, at = [], 0
    if not word or len(word) > max_chars:
        return []
    while at < len(word):
        for end in range(len(word), at, -1):
            own = ("##" if at else "") + word[at:end]
            if own in vocab or own.lower() in vocab:
                out.append(own)
                at = end
                break
        else:
            return []
    return out


def sample():
    rng = random.Random(11)
    letters = "abAB#éÉßİΣ"
    some = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    vocab = {some(3) for _ in range(60)} | {"##" + some(3) for _ in range(60)} | {"a", "##a", "b", "##b"}
    words = [some(9) for _ in range(400)] + ["", None, "a" * 12, "b" * 13, "ab", "ab"]
    return words, sorted(vocab)


def test_walk_follows_the_rule():
    words, vocab = sample()
    pieces = Pieces(vocab)
    assert all(pieces.split(w, 12) == plain(w, set(vocab), 12) for w in words)
    assert sum(bool(pieces.split(w, 12)) for w in words) > 20
    assert Pieces([]).split("a", 12) == []


def test_walk_equals_join(spark):
    words, vocab = sample()
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    table = spark.createDataFrame([(p,) for p in [*vocab, None, vocab[0]]], "piece string")
    as_rows = lambda f: sorted(((r.word, r.n, list(r.pieces), r.known) for r in f.collect()), key=repr)
    walked = as_rows(wordpiece_coverage(frame, table, max_chars=12))
    assert walked == as_rows(wordpiece_coverage(frame, table, max_chars=12, in_memory=5))
    assert {w: p for w, _, p, _ in walked} == {w: plain(w, set(vocab), 12) for w in words}
    assert as_rows(wordpiece_coverage(frame, table.limit(0))) == sorted(((w, words.count(w), [], False) for w in set(words)), key=repr)
    assert wordpiece_coverage(frame.limit(0), table).collect() == []
