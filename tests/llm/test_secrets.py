"""Secret scans against an independent scanner and a brute-force segmentation."""

import hashlib
import itertools
import math
import random
import re

import pytest

from salesmart.llm import secret_scan
from salesmart.llm.queries import QUERIES

DOCS = "doc_id long, text string"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def scanned(text):
    """Base spans character by character: (kind, start, end)."""
    out = []
    i = 0
    while i < len(text):        # assign
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey")
                     if text[i:i + len(w)].isascii() and text[i:i + len(w)].lower() == w), None)
        j = i + len(word) if word else 0
        if word:
            j += text[j:j + 1] in ("'", '"') and text[j:j + 1] != ""
            while text[j:j + 1] == " ":
                j += 1
            if text[j:j + 1] in (":", "=") and j < len(text):
                j += 1
                while text[j:j + 1] == " ":
                    j += 1
                quote = j + (text[j:j + 1] in ("'", '"') and j < len(text))
                end = quote
                while end < len(text) and text[end] in LETTERS:
                    end += 1
                if end > quote:
                    if end - quote >= 6:
                        out.append(("assign", i, end))
                    i = end
                    continue
        i += 1
    for kind, first, rest, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20),
                                     ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            end = i + len(first)
            if not text.startswith(first, i):
                i += 1
                continue
            while end < len(text) and text[end] in rest:
                end += 1
            if end - i >= least:
                out.append((kind, i, end))
            i = max(end, i + 1) if end > i + len(first) else i + 1
    return out


def digest(spans):
    order = ("assign", "access", "hex")
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(
        spans, key=lambda s: (s[1], order.index(s[0])))).encode()).hexdigest()


def test_base_spans_equal_an_independent_scanner(spark):
    sf_dir = "/root/testdata/sf0.01"      # the smallest tables hold no secrets
    draw = random.Random(1)
    bits = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789",
            "abcdef", "deadbeef", "x", "é", "K", "ſecret", "sec", "ret", "\n", "/+.", "AKIAAKIA"]
    made = ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(3000)]
    for text in made:
        assert sorted((secret_scan.KINDS[k], a, b) for a, k, b in secret_scan.base_spans(text)) == sorted(scanned(text)), text
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_secret_scan"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        want = scanned(docs[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")]
        assert r.base_sha256 == digest(want)


# -- segmentation ------------------------------------------------------------------

def part_costs(value, i, j, words):
    """All ways to guess value[i:j] as one segment that is not brute force."""
    part, low, out = value[i:j], value[i:j].lower(), []

    def one(c):
        return math.log10(3 if c == " " else 10 if c.isdigit() else 26 if c.isalpha() else 33)
    for text, extra in ((low, 0), (low.translate(str.maketrans("@4301$5!7", "aaeoissit")), .5)):
        if j - i >= 2 and text in words.rank:
            out.append(math.log10(words.rank[text] + 1) + extra + (0 if part == low else .3 if part.istitle() else .8))
    if j - i >= 3 and len(set(part)) == 1 and (j == len(value) or value[j] != value[j - 1]):
        out.append(one(part[0]) + math.log10(j - i))
    rows = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

    def near(a, b):
        for row in rows:
            if a in row and b in row and abs(row.index(a) - row.index(b)) == 1:
                return True
        return any(x in up and y in down and up.index(x) == down.index(y)
                   for x, y in ((a, b), (b, a)) for up, down in zip(rows[1:], rows[2:]))
    if j - i >= 3 and all(near(a, b) for a, b in zip(low, low[1:])):
        out.append(math.log10(47) + (j - i - 1) * math.log10(1.7))
    m = secret_scan._date.match(value, i)
    if m and m.end() == j:
        out.append(math.log10(365 * 120 if j - i > 4 else 120))
    if j - i >= 2 and i >= j - i and value[2 * i - j:i] == part:
        out.append(math.log10(len(value)))
    return out


def brute_cost(value, words):
    """The cheapest of all segmentations, each part brute force or a known kind."""
    best = math.inf
    n = len(value)
    for cuts in itertools.product((0, 1), repeat=n - 1):
        bounds = [0, *(k + 1 for k, c in enumerate(cuts) if c), n]
        total, after_brute = 0.0, False
        options = [(0.0, False)]
        for i, j in zip(bounds, bounds[1:]):
            known = part_costs(value, i, j, words)
            raw = sum(math.log10(3 if c == " " else 10 if c.isdigit() else 26 if c.isalpha() else 33) for c in value[i:j])
            new = []
            for total, after_brute in options:
                new += [(total + min(known) + .3, False)] if known else []
                new.append((total + raw + (0 if after_brute else .3), True))
            options = [min((o for o in new if o[1] is kind), default=None) for kind in (False, True)]
            options = [o for o in options if o]
        best = min(best, *(o[0] for o in options))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_cost_equals_brute_force(seed):
    draw = random.Random(seed)
    words = secret_scan.Ranked.of(["paint", "horse", "zq", "documentation"])
    bits = ["love", "Paint", "h0rse", "zq", "1987", "aaa", "qwe", "xx", "7", "#", "K", " ", "123", "20240131", "asd", "my", "zq"]
    for _ in range(60):
        value = "".join(draw.choice(bits) for _ in range(draw.randrange(1, 5)))[:11]
        cost, chain = secret_scan.guess_cost(value, words)
        assert cost == pytest.approx(brute_cost(value, words), abs=1e-9), value
        assert [i for _, i, _ in chain] + [len(value)] == [0] + [j for _, _, j in chain]


# -- words and values ----------------------------------------------------------------

WORDY = [(i, f"The documentation of this production was written yesterday, über {i} days."
             f" password: hunterxyzqwv and pwd: \"Sesameöffnedich zzkkqq\"") for i in range(40)]


def test_words_of_the_corpus_are_cheap_and_values_are_no_words(spark):
    words = secret_scan.ranked_words(spark.createDataFrame([*WORDY, (99, None), (98, ""), (97, "seldom")], DOCS))
    assert {"documentation", "production", "yesterday", "über"} <= set(words.rank)
    assert not {"hunterxyzqwv", "zzkkqq", "sesameöffnedich", "seldom"} & set(words.rank)
    for value in ("documentation", "production", "yesterday", "Production1", "documentationyesterday"):
        assert secret_scan.guess_cost(value, words)[0] < secret_scan.LEAST_COST
        assert secret_scan.guessed_spans(f"passphrase: {value}", [], secret_scan.LEAST_COST, words) == []
    few = secret_scan.ranked_words(spark.createDataFrame(WORDY, DOCS), bound=2)
    assert len(few.rank) == len(secret_scan.FIXED.rank) + 2


@pytest.mark.parametrize("text,value", [
    ('passphrase: "correct Horse battery 9#staple" ok', "correct Horse battery 9#staple"),
    ('{"password": "my secret Pa55#word!"}', "my secret Pa55#word!"), ("pwd: müller#9X!pq77 end", "müller#9X!pq77"),
    ("pwd: '日本語のパスワード9x' x", "日本語のパスワード9x"), ('pwd: "kX9#vT2!qLm8z and no closing', "kX9#vT2!qLm8z"),
    ('pwd: "kX9#vT2!qLm8z\nnext" line', "kX9#vT2!qLm8z"), (r'pwd: "a\" kX9#vT2!qLm8z" x', r'a\" kX9#vT2!qLm8z'),
    ("passcode = kX9#vT2!qLm8z　rest", "kX9#vT2!qLm8z")])
def test_values_with_blanks_and_any_letter(spark, text, value):
    found = secret_scan.guessed_spans(text, secret_scan.base_spans(text), secret_scan.LEAST_COST)
    assert value in [text[a:b] for a, _, b in found]
    left = secret_scan.redact_secrets(spark.createDataFrame([(1, text)], DOCS)).first().text
    assert value not in left and value[-5:] not in left


def test_keeping_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "pwd: kX9#vT2!qLm8z", 5)], DOCS + ", word int")
    row = secret_scan.scan_secrets(docs, ["word", "doc_id"]).first()
    assert (row.word, row.doc_id, re.fullmatch(r"guess:5:18", row.spans) is not None) == (5, 1, True)
    assert secret_scan.redact_secrets(docs.limit(0)).count() == secret_scan.scan_secrets(docs.limit(0), ["doc_id"]).count() == 0
