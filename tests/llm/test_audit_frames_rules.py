"""Source divergence, fill-in-middle over frames, and the rule cascade, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from salesmart.llm import divergence, frames, rules

DOCS = "doc_id long, text string, lang string, source string, rank int"
LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [
    (None, "a b c", "en", "x", 1), (1, None, None, None, 2), (2, "", "en", "", 3), (3, " \n\t ", "", "x", 4),
    (4, "x", "en", "x", 5), (5, "x", "en", "y", 6), (5, "x", "en", "y", 6), (6, LONG, "de", "x", 7),
    (7, LONG, "de", "x", 8), (8, "Ünï cödé 日本語 text’s “end” don't 12,345\n\n  tabs\t\tand 𝒳𝒴 spaces   ", "en", "z", 9),
    (9, "holds <S> a mark", "en", "z", 9), (10, "ÄÄ Ää Éx A\x00B a b", "en", "y", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# -- source divergence ------------------------------------------------------

def audit(rows, least, top):
    """Both parts in plain integers."""
    lists = [([w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")], l or "", s or "")
             for _, t, l, s, *_ in rows]
    out = set()
    for lang in {l for _, l, _ in lists}:
        mine = [(w, s) for w, l, s in lists if l == lang]
        in_docs = Counter(w for words, _ in mine for w in set(words))
        kept = sorted(w for w, n in in_docs.items() if n >= least)
        counts = defaultdict(Counter)
        for words, s in mine:
            counts[s].update(w for w in words if in_docs[w] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            size = sum(c.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // size for w in kept}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in p:
            pairs = [(sum((p[s][w] - p[o][w])**2 // (p[s][w] + p[o][w]) for w in kept), o) for o in p if o != s]
            terms = [((p[s][w] - q[w])**2 // (p[s][w] + q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(best)}
    return out


LOWER = {i: i + 32 for i in range(65, 91)}


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_docs(n, sources, kinds, seed):
    draw = random.Random(seed)
    vocabulary = [a + b for a in "abcdeéü日" for b in "xyzXYZ𝒳"][:kinds]
    out = []
    for i in range(n):
        source = f"s{min(draw.randrange(sources), draw.randrange(sources))}" if draw.random() > .3 else "s0"
        words = [vocabulary[int(draw.random() ** 2 * kinds)] for _ in range(draw.randrange(30))]
        out.append((i, "-".join(words), draw.choice(["en", "en", "de", None]), source, 1))
    return out


def test_audit_equals_brute_force(spark):
    for rows, least, top in ((random_docs(300, 8, 50, 1), 10, 10), (random_docs(60, 3, 30, 2), 2, 3), (ODD, 2, 10),
                             (ODD, 1, 2)):
        docs = spark.createDataFrame(rows, DOCS).repartition(5)
        assert found(divergence.audit_sources(docs, top, least)) == audit(rows, least, top)


def test_audit_of_more_sources_than_a_block(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("abcdefgh") for _ in range(9)), "en", f"s{i % 270}", 1) for i in range(540)]
    df = divergence.audit_sources(spark.createDataFrame(rows, DOCS))
    assert found(df.where("source IN ('s0', 's99', 's269')")) == {
        r for r in audit(rows, 10, 10) if r[1] in ("s0", "s99", "s269")}


def test_audit_without_terms_or_rows(spark, nothing):
    assert found(divergence.audit_sources(nothing)) == set()
    rows = [(1, "once", "en", "a", 1), (2, "", "en", "b", 1), (3, None, "de", "b", 1)]
    assert found(divergence.audit_sources(spark.createDataFrame(rows, DOCS))) == {
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 16)
    text = "some Words, and a verylongwordthatgoesbeyondapiece again " * 5 + "end"
    assert [w for ws in divergence._term_lists(text.encode()) for w in ws] == [
        w.lower().encode() for w in re.findall("[A-Za-z]+", text)]


def test_shares_of_huge_counts(spark):
    cases = [(0, 0, 1), (7 * 10**12, 9 * 10**12, 10**9), (10**12 + 1, 10**15, 3), (5, 5, 1)]
    rows = spark.createDataFrame(cases, "n long, size long, kinds long")
    got = [r[0] for r in rows.select(divergence.share(F.col("n"), F.col("size"), F.col("kinds"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (size + 2 * kinds) for n, size, kinds in cases]


@pytest.mark.parametrize("k", [1, 3])
def test_skyband_equals_brute_force(spark, k):
    draw = random.Random(k)
    points = [(draw.choice("aab"), draw.randrange(40), draw.randrange(40), f"n{i:04}") for i in range(1500)]

    def dominators(p):
        return sum(q[0] == p[0] and q[1] >= p[1] and q[2] <= p[2] and q[3] < p[3] for q in points)
    df = spark.createDataFrame(points, "g string, high long, low long, name string").repartition(7)
    got = {tuple(r) for r in divergence.skyband(df, ["g"], "high", "low", "name", k).collect()}
    assert got == {p for p in points if dominators(p) < k}


# -- fill in middle -----------------------------------------------------------

def filled(doc_id, text, seed=1):
    """(form, prefix, middle, output) as the contract words it."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [4, 50, frames.FRAME_BYTES])
def test_fill_in_middle_equals_plain_strings(spark, size):
    rows = ODD + [(i, f"<{'日é𝒳a'[i % 4] * (i % 9)}> <P <S M>" * (i % 5), "en", "q", i) for i in range(20, 120)]
    docs = spark.createDataFrame(rows, DOCS).drop("lang")
    out = frames.fill_in_middle(frames.draw(frames.store(docs, size)))
    texts = sorted((r.rank, r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in frames.texts(out).select(
        "rank", "n", "form", F.coalesce("prefix_chars", F.lit(-1)).alias("prefix_chars"),
        F.coalesce("middle_chars", F.lit(-1)).alias("middle_chars"), "text").collect())
    wanted = [(r[4], r[1], filled(r[0], r[1])) for r in rows]
    assert texts == sorted((k, len(t or ""), w[0], -1 if w[1] is None else w[1], -1 if w[2] is None else w[2], w[3])
                           for k, t, w in wanted)
    digests = sorted((r.rank, r.output_sha256, r.restored_sha256) for r in frames.digests(out).collect())
    assert digests == sorted((k, sha(w[3]), sha(t or "")) for k, t, w in wanted)
    assert {w[0] for *_, w in wanted} == {"plain", "psm", "spm"}


def test_only_cut_frames_are_opened(monkeypatch):
    codec = frames.Codec(64)
    text = "".join(random.Random(5).choice("abcdé日𝒳 ") for _ in range(5000))
    stored = list(codec.pack(text.encode()))
    opened = []
    whole = codec.open
    monkeypatch.setattr(codec, "open", lambda frame: opened.append(frame) or whole(frame))
    out = frames.rearranged(codec, stored, "psm", 1234, 3456)
    assert len(opened) <= 4 and len({f[2] for f in opened}) <= 2
    kept = {f[2] for f in stored}
    assert sum(f[2] in kept for f in out) >= len(stored) - 2
    assert "".join(map(whole, out)) == f"<P>{text[:1234]}<S>{text[3456:]}<M>{text[1234:3456]}"
    assert [f[0] for f in out] == [sum(f[1] for f in out[:i]) for i in range(len(out))]
    opened.clear()
    assert "".join(codec.read(stored, 2000, 2010)) == text[2000:2010] and len(opened) <= 2
    assert "".join(codec.restored(out, "psm")) == text


def test_very_long_text_and_empty_table(spark, nothing):
    text = "日本語 and plain words " * 400_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = frames.digests(frames.fill_in_middle(frames.draw(frames.store(docs)))).first()
    assert (row.n, row.output_sha256, row.restored_sha256) == (len(text), sha(filled(1, text)[3]), sha(text))
    assert frames.digests(frames.fill_in_middle(frames.draw(frames.store(nothing)))).count() == 0
    clashing = docs.withColumns({"frames": F.lit(1), "N": F.lit(2), "first": F.lit(3), "marked": F.lit(4)})
    again = frames.digests(frames.fill_in_middle(frames.draw(frames.store(clashing)))).first()
    assert (again["n"], again["first"], again["output_sha256"]) == (row.n, 3, row.output_sha256)


# -- rules ----------------------------------------------------------------------

def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    copies = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if copies[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
              len(repeated))
    return (*counts, len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_measures_equal_brute_force(spark, sf_dir):
    given = [(r.doc_id, r.text, r.lang, r.source, 0) for r in
             spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    draw = random.Random(4)
    made = [(i, "".join(draw.choice(["a ", "b ", "c\n", "a\t", "#", "é\n", "\x0b", "\x1c", " \n"]) for _ in range(i)),
             "en", "x", 0) for i in range(150)]
    rows = [*ODD, *given, *made]
    df = rules.apply_rules(spark.createDataFrame(rows, DOCS).repartition(4), order=list(rules.default_rules()))
    got = Counter((r.doc_id, r.text, *[r[c] for c in rules.MEASURES], r.base_failed) for r in df.collect())
    assert got == Counter((r[0], r[1], *measures(r[1])) for r in rows)
    assert df.where("base_failed AND kept").count() == 0


def test_every_rule_rejects_and_order_changes_no_verdict(spark):
    words = [f"{a}{b}rn" for a in ("hou", "ga", "che", "mo", "pla", "ste", "wa") for b in ("da", "lu", "ki", "so", "ne", "t", "p",
                                                                                "x", "v")]
    clean = " ".join(words)
    cases = {
        None: clean,
        "base": "too short",
        "word_length": " ".join(w * 5 for w in words),
        "symbols": " ".join(w + "#" * (i % 2) for i, w in enumerate(words)),
        "duplicate_lines": clean + "\nsame line" * 4,
        "capitals": clean.upper(),
        "few_letters": " ".join(w + "12345678" for w in words),
        "bullets": "\n".join("- " + w + " " + v for w, v in zip(words, reversed(words))),
        "cut_lines": "\n".join(w + " " + v + " ..." for w, v in zip(words, reversed(words))),
        "placeholder": clean + " Lorem Ipsum",
        "few_kinds": " ".join(("a" if i % 3 else "b") + "c" for i in range(200)),
    }
    docs = spark.createDataFrame([(str(k), v) for k, v in cases.items()], "kept_by string, text string")
    names = list(rules.default_rules())
    for order in (names, names[::-1], None):
        df = rules.apply_rules(docs, order=order)
        got = {r.kept_by: (r.kept, r.rejected_by) for r in df.collect()}
        assert {k for k, (kept, _) in got.items() if kept} == {"None"}
        assert got["base"][1] == "base"
    one_at_a_time = rules.default_rules()
    for name in names[:-1]:
        alone = rules.apply_rules(docs, {name: one_at_a_time[name]}, [name])
        assert alone.where(F.col("kept_by") == name).first().rejected_by == name
        assert alone.where("kept_by = 'None'").first().kept


def test_order_is_by_rejections_per_second():
    assert rules.best_order({"dear": (4.0, .4), "cheap": (.1, .2), "never": (.1, 0.), "tie": (1.0, .1)}) == [
        "cheap", "tie", "dear", "never"]


def test_rules_on_odd_tables(spark, odd, nothing):
    assert rules.apply_rules(nothing).count() == 0
    order = list(rules.default_rules())
    clashing = odd.withColumns({"Kept": F.lit(1), "_words": F.lit("w"), "n_words": F.lit("x"), "_text": F.lit("t")})
    got = rules.apply_rules(clashing, order=order)
    assert got.columns == [*odd.columns, "_words", "_text", *rules.MEASURES, "base_failed", "rejected_by", "kept"]
    assert Counter(map(str, got.drop("_words", "_text").collect())) == Counter(
        map(str, rules.apply_rules(odd, order=order).collect()))
    with pytest.raises(ValueError):
        rules.apply_rules(odd, order=["symbols"])
    long = spark.createDataFrame([("word%d next " % 1 * 300_000,)], "text string")
    row = rules.apply_rules(long, order=list(rules.default_rules())).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (600_000, 600_000, False)
    plan = rules.apply_rules(odd, order=list(rules.default_rules()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
