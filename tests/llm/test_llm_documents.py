import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from refweave.llm import mixing, repetition, tokens, windows

WORDS = "red blue green harbour winter über école река norm value".split()


def brute_share(text, n):
    w = re.findall(r"[^\W\d_]+", (text or "").lower())
    seen, covered = set(), set()
    for k in range(len(w) - n + 1):
        gram = tuple(w[k : k + n])
        if gram in seen:
            covered.update(range(k, k + n))
        seen.add(gram)
    return len(covered) / max(1, len(w))


def test_repetition_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "123 !!", "one", "a b c d e f g h " * 3, "Same line here\nSame line here\nother", "x" * 60_000]
    for _ in range(40):
        part = rng.choices(WORDS, k=rng.randint(1, 30))
        texts.append(rng.choice([" ", ", ", " 7 ", "\n"]).join(part * rng.randint(1, 3) + rng.choices(WORDS, k=10)))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, words int")
    for r in repetition.repetition(df).collect():
        for n in (3, 5, 8, 12):
            assert r[f"words_in_repeated_{n}"] == pytest.approx(brute_share(texts[r.doc_id], n)), (texts[r.doc_id], n)
    lines = {r.doc_id: r.chars_in_repeated_lines for r in repetition.repetition(df).collect()}
    assert lines[5] == pytest.approx(14 / 33) and lines[0] == 0
    assert repetition.repetition(df.limit(0)).collect() == []


def test_token_counts_equal_the_tokenizer():
    encode = tokens.encoding().encode_ordinary
    rng = random.Random(1)
    pieces = ["a", " ", "  ", "\n", "\t", "don't", "Über", "2020", "...", "　", " ", "x" * 80, "'s", "é", "река", "-", "​"]
    for _ in range(400):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        assert tokens.count_tokens(text) == len(encode(text)), repr(text)
    assert tokens.count_tokens(None) == tokens.count_tokens("") == 0


@pytest.mark.parametrize("seed", range(5))
def test_packed_windows_hold_everything_once(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(1, 20), 100]) for _ in range(rng.randint(1, 120))]
    parts = windows.packed(sizes, 100)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in p) for p in parts) <= 100


def test_differencing_is_near_equal():
    parts = windows.differenced([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]


def test_fill(spark):
    sizes = [(1, 0), (2, 10), (3, 25), (4, 7), (5, 10), (6, 9), (7, 1)]
    got = windows.fill(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), spark.createDataFrame([("s", 10), ("l", 30)], "containername string, capacity bigint")).collect()
    for name, capacity in (("s", 10), ("l", 30)):
        own = [r for r in got if r.containername == name]
        load, docs = {}, {}
        for r in own:
            load[r.container] = load.get(r.container, 0) + r.tokens
            docs.setdefault(r.doc_id, []).append((r.start, r.tokens))
        assert max(load.values()) <= capacity
        for doc, n in sizes:
            pieces = sorted(docs[doc])
            assert sum(t for _, t in pieces) == n and (len(pieces) == 1 or n > capacity)
            assert [s for s, _ in pieces] == list(np.cumsum([0] + [t for _, t in pieces])[:-1])
    empty = windows.fill(spark.createDataFrame([], "doc_id bigint, tokens bigint"), spark.createDataFrame([("s", 10)], "containername string, capacity bigint"))
    assert empty.collect() == []
    none = windows.fill(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), spark.createDataFrame([("s", 0)], "containername string, capacity bigint"))
    assert none.collect() == []


def test_packed_takes_no_window_more_than_it_must():
    rng = random.Random(8)
    for _ in range(20):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(20, 150))]
        used = len(windows.packed(sizes, 100))
        fewer = windows.differenced(sizes, used - 1)
        assert any(sum(sizes[i] for i in p) > 100 for p in fewer)


def test_mixes_keep_weights_and_caps(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big", " BIG", "mid", "mid ", "tiny", None, "other"]) if i > 20 else "tiny", rng.randint(1, 60)) for i in range(3000)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("m", "big", 0.5, 3), ("m", "mid", 0.3, 3), ("m", "tiny", 0.2, 3), ("m", "absent", 0.5, 3)], "mixname string, source string, weight double, maxrepeats bigint")
    chosen = mixing.mixed(sizes, targets)
    rows = chosen.collect()
    assert max(r.copies for r in rows) <= 3 and {r.source for r in rows} == {"big", "mid", "tiny"}
    assert len({r.doc_id for r in rows}) == len(rows)
    share = {r.source: r.share for r in mixing.shares(chosen, targets).collect()}
    assert share["big"] == pytest.approx(0.5, abs=0.01) and share["tiny"] == pytest.approx(0.2, abs=0.01) and share["absent"] == 0
    assert mixing.mixed(sizes.limit(0), targets).collect() == []


def test_ranks_follow_the_order_within_a_heavy_value(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "x", (i * 7919) % 101) for i in range(500)], "doc_id bigint, source string, tokens bigint")
    got = mixing.ranked(df, "source", ["tokens", "doc_id"]).collect()
    for s in ("hot", "x"):
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.tokens, r.doc_id))
        assert [r["rank"] for r in own] == list(range(len(own)))
    assert df.agg(F.count("*")).first()[0] == len(got)
