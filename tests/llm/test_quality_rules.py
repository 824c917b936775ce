import re
from collections import Counter

from sylvane.llm import quality_rules as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    counts, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if counts[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_measures(spark, odd_docs, odd_rows):
    rows = Q.quality_rules(odd_docs).collect()
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == sorted(((-1 if d is None else d), *brute(t)) for d, t, *_ in odd_rows)
    assert all(not (r["kept"] and r["base_failed"]) for r in rows)


def lines(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in Q.quality_rules(docs).collect()}


def test_line_rules(spark):
    clean = "\n".join(f"Item{i} says that{i} thing, then it{i} turns to subject{i * 7}." for i in range(20))
    bad = ["Buy### now*** for$$$ less%%%", "Home | News | About | Contact", "READ THIS AND SHOUT LOUD", "WOW!! YES!! NOW!! GO!!", "spam " * 30, "All Rights Reserved by us.", "word " * 3 + " ".join(f"a{i}" for i in range(80))]
    found = lines(spark, clean, clean + "\n" + "\n".join(bad), "\n".join(bad * 3))
    assert found[0]["kept"] and found[0]["cleaned"] == clean and found[0]["n_failed_lines"] == 0
    assert found[1]["n_failed_lines"] == len(bad) and found[1]["cleaned"] == clean
    assert not found[2]["kept"]


def test_cleaned_documents_keep_all_columns(spark, odd_docs, no_docs):
    made = Q.clean_documents(odd_docs)
    assert made.columns == odd_docs.columns
    kept = {r["doc_id"] for r in Q.quality_rules(odd_docs).where("kept").collect()}
    assert {r[0] for r in made.collect()} == kept
    assert Q.clean_documents(no_docs).count() == 0 and Q.quality_rules(no_docs).count() == 0


def test_no_python_in_the_plan(spark, odd_docs):
    plan = Q.quality_rules(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
