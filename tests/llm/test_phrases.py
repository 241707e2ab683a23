"""Phrase collocations against brute force, on small awkward tables."""

import random
import re
from collections import Counter

from gradewalk.llm import phrases

SCHEMA = "doc_id long, text string, lang string, piece string, n long, rank int"


def brute(rows, least=100, longest=5, cover=100, top=2000):
    total, count = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                count.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {g: f for g, f in count.items() if f >= least}
    inside = {}
    for (lang, g), f in often.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                key = (lang, g[i : i + k])
                inside[key] = max(inside.get(key, 0), f)
    found = {}
    for (lang, g), a in often.items():
        if len(g) > 1 and not 100 * inside.get((lang, g), 0) >= cover * a:
            score, k = min((1000 * a * total[lang] // (count[lang, g[:k]] * count[lang, g[k:]]), k) for k in range(1, len(g)))
            found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), count[lang, g[:k]], count[lang, g[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, le, ri, total[lang], -s) for lang, own in found.items() for r, (s, a, p, le, ri) in enumerate(sorted(own)[:top]))


def mined(spark, rows, **more):
    return sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA), **more).collect())


def texts():
    rnd = random.Random(8)
    common = "the of and to in is was".split()
    word = lambda: rnd.choice(common) if rnd.random() < 0.6 else f"w{rnd.randrange(30)}"
    rows = []
    for k in range(300):
        t = " ".join(word() + rnd.choice(["", "", "", ",", ".", "\n", "\t", "  ", "!", "\x0b"]) for _ in range(rnd.randrange(80)))
        rows.append((k, t.upper() if k % 9 == 0 else t, ["en", "fr", None, "und"][k % 4], "x", 1, 2))
    rows += [(1000 + k, "Copied line of text here. Été   naïve", "en", None, None, None) for k in range(40)]
    rows += [(None, "a a a a a a", "en", None, None, None), (5, None, "en", None, None, None), (6, "", None, None, None, None), (7, " .,; \t\n", "de", None, None, None), (8, "x y " * 3000, "de", None, None, None)]
    return rows


def test_collocations_match_brute_force(spark):
    rows = texts()
    for more in ({"least": 12}, {"least": 30, "longest": 3, "cover": 60, "top": 7}, {"least": 40, "longest": 2}):
        got = mined(spark, rows, **more)
        assert got == brute(rows, **more) and got


def test_collocations_of_empty_tables_and_repeated_rows(spark):
    rows = texts()
    assert mined(spark, []) == []
    assert mined(spark, rows * 2, least=24) == brute(rows * 2, least=24)


def test_runs_and_full_filters_change_no_count(spark, monkeypatch):
    """Counts don't depend on how many words are added up at once, nor on a filter that lets everything through."""
    held = phrases.pieces(spark.createDataFrame(texts(), SCHEMA)).persist()
    want = {tuple(r) for r in phrases.frequent_grams(held, 20).collect()}
    run = phrases.Run("en", ["a b c", "b c"], [2, 3])
    full = phrases.Filter(b"\xff" * 256, 8)
    grams = lambda *f: {(r["gram"], r["f"]) for b in run.grams(*f, 5) for r in b.to_pylist()}
    assert grams(None, None) == {("a", 2), ("b", 5), ("c", 5)} and grams(full, None) == {("a b", 2), ("b c", 5)} and grams(full, full) == {("a b c", 2)}
    every = phrases.bucket_counts(phrases.partial_counts(held, full, full), 20)
    assert {tuple(r) for r in every.collect()} == {r for r in want if r[1] > 2}
