import random
import re

from lexmill.llm.quality_rules import repetition_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text, min_repeat=10):
    words = WORD.findall(text or "")
    n = len(words)

    def repeated(k):
        seen = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(words[i : i + k]), []).append(i)
        return {i for at in seen.values() if len(at) > 1 for i in at}

    five = {j for i in repeated(5) for j in range(i, i + 5)}
    lines, dup, before = (text or "").split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in before
            before.add(line)
    long = {j for i in repeated(min_repeat) for j in range(i, i + min_repeat)}
    longest = next((k for k in range(n, 0, -1) if repeated(k)), 0)
    failed = n < 10 or 100 * len(five) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(five), len(long), longest, failed, not failed and len(long) <= 0.15 * n and longest <= 100)


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "x " * 70, "# | é", "l1 a b\nl1 a b\n \n\nl1 a b \nz", "one two three four five six seven eight nine ten eleven"]
    for _ in range(60):
        words = [rng.choice(["ab", "c", "dé", "<p>", "漢字", "$%"] + [f"w{i}" for i in range(rng.choice([3, 300]))]) for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.5:
            words += words[: rng.randrange(len(words))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", " x "]) for w in words))
    rows = list(enumerate(texts)) + [(5, texts[5])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = sorted(tuple(r) for r in repetition_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept").collect())
    assert got == sorted((i, *brute(t)) for i, t in rows)


def test_long_repetition_and_empty(spark):
    text = "same word here " * 30000
    row = repetition_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_repeat_words == row.n_words == 90000 and row.longest_repeat == 89997 and not row.kept
    assert repetition_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
