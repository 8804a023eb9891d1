"""The benchmark search against plain BM25 over every passage and item."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from salesmart.llm import decontam

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, share=0.6, overlap=0.8, least=5):
    """{(doc place, item place): (score, overlaps)} by scoring every passage against every item."""
    kept = {i: words(t) for i, (_, t) in enumerate(items) if len(words(t)) >= least}
    if not kept:
        return {}
    mean = sum(map(len, kept.values())) / len(kept)
    df = Counter(w for ws in kept.values() for w in set(ws))

    def impacts(ws):
        return {w: math.log(1 + (len(kept) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (
            n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in Counter(ws).items()}
    out = {}
    for i, ws in kept.items():
        gains = impacts(ws)
        stride = max(8, 1 << (len(ws) - 1).bit_length())
        sides = [words(x) for x in decontam.ANSWER_MARK.split(items[i][1], maxsplit=1)]
        runs = [{tuple(s[k:k + min(5, len(s))]) for k in range(len(s) - min(5, len(s)) + 1)} for s in sides if s]
        for d, (_, text) in enumerate(docs):
            have = words(text)
            for start in range(0, len(have), stride):
                passage = have[start:start + 2 * stride]
                score = sum(g for w, g in gains.items() if w in set(passage))
                if score < share * sum(gains.values()) - 1e-9:
                    continue
                shares = [sum(any(tuple(passage[k:k + len(r)]) == r for k in range(len(passage))) for r in side) / len(side)
                          for side in runs]
                if min(shares) >= overlap:
                    row = (round(score, 9), round(shares[0], 9), round(shares[1] if len(shares) > 1 else 1.0, 9))
                    out[d, i] = max(out.get((d, i), row), row)
    return out


def made(seed, n_docs=40, n_items=60, kinds=300):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(kinds)] + ["Ünï", "日本", "THE", "a"]

    def text(n):
        return " ".join(vocabulary[int(draw.random() ** 3 * len(vocabulary))] for _ in range(n))
    docs = [text(draw.randrange(300)).split(" ") for _ in range(n_docs)]
    items = []
    for k in range(n_items):
        source = draw.choice(docs)
        a = draw.randrange(max(1, len(source)))
        item = source[a:a + draw.choice([3, 5, 6, 9, 16, 17, 40, 90])] if k % 3 else text(draw.randrange(1, 60)).split(" ")
        if k % 4 == 0 and item:
            item[draw.randrange(len(item))] = "changed"
        if k % 5 == 0:
            item.insert(max(1, len(item) - draw.choice([2, 7])), "\nAnswer: ")
        items.append((k, " ".join(item)))
    items += [(900, items[1][1]), (900, items[1][1]), (901, None), (902, "")]     # repeated, null and empty items
    return [(k, ", ".join(t)) for k, t in enumerate(docs)] + [(7, None), (7, "")], items


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_brute_force(seed, monkeypatch):
    docs, items = made(seed)
    want = brute(docs, items)
    assert len(want) > 20
    for pairs in (1 << 20, 50):     # batches of any size
        monkeypatch.setattr(decontam, "PAIRS_AT_ONCE", pairs)
        monkeypatch.setattr(decontam, "VERIFIED_AT_ONCE", pairs)
        index = decontam.build_index([(i, t) for i, (_, t) in enumerate(items)])
        got = {(d, index.item_ids[k]): tuple(round(x, 9) for x in row)
               for d, _, k, *row in decontam.search([index], pa.array([t or "" for _, t in docs]))}
        assert got == want


def test_tables_equal_brute_force_however_items_are_dealt(spark):
    docs, items = made(9)
    want = Counter((docs[d][0], items[i][0], *row) for (d, i), row in brute(docs, items).items())
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    bench = spark.createDataFrame(items, ITEMS)
    for at_once in (20_000, 9):     # one index, and seven in two readings
        got = Counter((r.doc_id, r.item_id, *(round(x, 9) for x in (r.score, r.question_overlap, r.answer_overlap)))
                      for r in decontam.find_leaks(frame, bench, items_at_once=at_once).collect())
        assert got == want
    left = sorted(str(r.text) for r in decontam.drop_leaked(frame, bench, items_at_once=9).collect())
    leaked = {d for d, _ in brute(docs, items)}
    assert left == sorted(str(t) for d, (_, t) in enumerate(docs) if d not in leaked)


def test_short_items_if_asked_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "say short one now", 5, 2), (2, "short, but not one", 6, 2)],
                                 "doc_id long, text string, score int, part int")
    bench = spark.createDataFrame([(1, "Short one", "x")], "item_id long, text string, part string")
    assert decontam.find_leaks(docs, bench).count() == 0
    assert [r.doc_id for r in decontam.find_leaks(docs, bench, least_words=2).collect()] == [1]
    assert [tuple(r) for r in decontam.drop_leaked(docs, bench, least_words=2).collect()] == [(2, "short, but not one", 6, 2)]


def test_many_items_and_a_long_text_take_bounded_time_and_memory():
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = " ".join(vocabulary[int(draw.random() ** 2 * 3000)] for _ in range(300_000))
    ws = text.split(" ")
    items = []
    for k in range(8000):
        a = draw.randrange(len(ws) - 40)
        items.append((k, " ".join(ws[a:a + 40] if k % 100 == 0 else draw.sample(vocabulary, 40))))
    index = decontam.build_index(items)
    found = {(d, index.item_ids[k]) for d, _, k, *_ in decontam.search([index], pa.array([text]))}
    assert found == {(0, k) for k in range(0, 8000, 100)}
