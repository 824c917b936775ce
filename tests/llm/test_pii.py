import hashlib
import re
import time

import pytest

from sylvane.llm import pii

KEY = "k"


def rounds(kind, a, b, size_a, size_b):
    """The network again, in plain Python."""

    def mix(side, r, other, size):
        text = f"{KEY}:{kind}:{size_a}:{size_b}:{side}:{r}:{other}"
        return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % size

    for r in range(1, pii.ROUNDS + 1):
        a = (a + mix("a", r, b, size_a)) % size_a
        b = (b + mix("b", r, a, size_b)) % size_b
    return a, b


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total


def found(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(pii.pseudonymise(docs, KEY).collect(), key=lambda r: r["doc_id"])]


def test_cards(spark):
    cards = ["4785380592391139", "4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009"]
    for card, row in zip(cards, found(spark, *[f"pay {c}." for c in cards])):
        digits = re.sub(r"\D", "", card)
        body, half = digits[1:-1], (len(digits) - 2) // 2
        a, b = rounds("card", int(body[:half]), int(body[half:]), 10**half, 10 ** (len(body) - half))
        expected = digits[0] + str(a).zfill(half) + str(b).zfill(len(body) - half)
        expected += str(-luhn(expected + "0") % 10)
        made = row["pii"][0]["pseudonym"]
        assert re.sub(r"\D", "", made) == expected and luhn(expected) % 10 == 0
        assert re.sub(r"\d", "9", made) == re.sub(r"\d", "9", card)
        assert row["text"] == f"pay {made}."


def test_ips_phones_and_ssns(spark):
    rows = found(spark, "at 10.20.30.40, ok", "+1 (743) 555-3824", "123-45-6789")
    a, b = rounds("ip", 10 * 256 + 20, 30 * 256 + 40, 65536, 65536)
    assert rows[0]["text"] == f"at {a // 256}.{a % 256}.{b // 256}.{b % 256}, ok"
    a, b = rounds("phone", 74355, 53824, 100_000, 100_000)
    d = f"{a:05}{b:05}"
    assert rows[1]["text"] == f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"
    a, b = rounds("ssn", 122, 44 * 9999 + 6788, 898, 99 * 9999)
    area = a + 1 + (a + 1 >= 666)
    assert rows[2]["text"] == f"{area:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


@pytest.mark.parametrize("text", ["2001-02-28", "28.02.2001", "2/3/2001"])
def test_dates(spark, text):
    import datetime

    row = found(spark, f"on {text} then")[0]
    y, m, d = {"2001-02-28": (2001, 2, 28), "28.02.2001": (2001, 2, 28), "2/3/2001": (2001, 3, 2)}[text]
    first = datetime.date(1900, 1, 1)
    day = (datetime.date(y, m, d) - first).days
    a, b = rounds("date", day // 229, day % 229, 319, 229)
    to = first + datetime.timedelta(a * 229 + b)
    made = row["pii"][0]["pseudonym"]
    numbers = [int(x) for x in re.split("[-./]", made)]
    assert sorted(numbers) == sorted([to.year, to.month, to.day]) and row["text"] == f"on {made} then"


def test_equal_values_stay_linked_and_others_apart(spark):
    rows = found(spark, "a 1.2.3.4 b 1.2.3.4", "1.2.3.5", "x@y.example.com X@Y.example.com", "z@y.example.com")
    assert len({p["pseudonym"] for p in rows[0]["pii"]}) == 1 and rows[1]["text"] not in rows[0]["text"]
    assert rows[2]["pii"][0]["pseudonym"] == rows[2]["pii"][1]["pseudonym"] != rows[3]["pii"][0]["pseudonym"]
    assert rows[2]["pii"][0]["pseudonym"].split("@")[1] == rows[3]["pii"][0]["pseudonym"].split("@")[1]


def test_invalid_candidates_stay(spark):
    kept = ["4785380592391138", "9870157079875996", "999.1.1.1", "1.2.3.4.5", "31/31/2001", "000-12-3456", "1899-01-01", "v1.2", "a@b", "12345678901234567890123"]
    assert [r["text"] for r in found(spark, *kept)] == kept


def test_the_network_is_a_bijection():
    assert len({rounds("date", a, b, 11, 13) for a in range(11) for b in range(13)}) == 143


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    made = pii.pseudonymise(odd_docs, KEY).collect()
    given = {d: t for d, t, *_ in odd_rows}
    assert len(made) == len(odd_rows)
    for r in made:
        t = given[r["doc_id"]]
        if r["pii"]:
            out, at = "", 0
            for x in r["pii"]:
                out, at = out + t[at : x["start"]] + x["pseudonym"], x["end"]
            assert r["text"] == out + t[at:]
        else:
            assert r["text"] == t
    whole = pii.pseudonymise_documents(odd_docs, KEY)
    assert whole.columns == odd_docs.columns and whole.count() == len(odd_rows)
    assert pii.pseudonymise(no_docs, KEY).count() == 0
    assert "Python" not in whole._jdf.queryExecution().toString()


def test_cards_beside_other_numbers(spark):
    card, spaced = "4111111111111111", "4111 1111 1111 1111"
    texts = [
        f"{card} 12/26", f"{spaced} 123", f"12 34 {spaced}", f"no 7 {card}", f"{card} 5500-0000-0000-0004 99", f"{spaced} 12a", f"41111111 11111111 12",
        f"{card} 2001-02-28", f"{card} 10.20.30.40", f"743-555-3824 {card}", f"123-45-6789 {card} 1", f"{card} 12@x.example.com", "9" * 5000 + f" {card} " + "1 " * 500,
    ]
    kinds = [["card"]] * 4 + [["card", "card"], ["card"], ["card"], ["card", "date"], ["card", "ip"], ["phone", "card"], ["ssn", "card"], ["card", "email"], ["card"]]
    for text, expected, row in zip(texts, kinds, found(spark, *texts)):
        assert [x["kind"] for x in row["pii"]] == expected, text
        out, at = "", 0
        for x in row["pii"]:
            if x["kind"] == "card":
                assert 13 <= len(re.sub(r"\D", "", text[x["start"] : x["end"]])) <= 19 and luhn(re.sub(r"\D", "", text[x["start"] : x["end"]])) % 10 == 0
            out, at = out + text[at : x["start"]] + x["pseudonym"], x["end"]
        assert row["text"] == out + text[at:] and card not in row["text"] and spaced not in row["text"]


def rebuilt(text, row):
    out, at = [], 0
    for x in row["pii"]:
        out += [text[at : x["start"]], x["pseudonym"]]
        at = x["end"]
    return "".join(out) + text[at:]


def test_time_is_linear_in_the_findings(spark):
    card = "4111111111111111"
    for unit, of_unit in ((f"a {card} b 1.2.3.4, x@y.example.com\n", 3), (f"{card} 7 ", 1)):
        for n in (500, 10_000):
            text = unit * n
            began = time.perf_counter()
            (row,) = found(spark, text)
            took = time.perf_counter() - began
            assert len(row["pii"]) == n * of_unit and row["text"] == rebuilt(text, row) and card not in row["text"]
        assert took < 60


def test_megabytes_of_one_unit(spark):
    units = ("7", "1 ", "1-", "a", "@", ".", "a.", "1.", " ", "\n", "x@", "é", "+1 ")
    texts = [u * (300_000 // len(u)) for u in units] + ["x@" + "a." * 200_000 + "com", "x@" + "a." * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs, KEY).collect()}
    assert all(rows[i]["text"] == rebuilt(t, rows[i]) for i, t in enumerate(texts))
    assert [x["kind"] for x in rows[len(units)]["pii"]] == ["email"] and not rows[0]["pii"] and not rows[3]["pii"]


def test_the_key_is_in_no_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = pii.pseudonymise(docs, "key-of-this-test")
    assert made.collect() and made.collect() == pii.pseudonymise(docs, "key-of-this-test").collect()
    for plan in (made._jdf.queryExecution().toString(), made._jdf.queryExecution().analyzed().treeString(), made._jdf.queryExecution().executedPlan().treeString()):
        assert "key-of-this-test" not in plan and "RDD" not in plan and "Python" not in plan


def test_domains_of_addresses(spark):
    texts = ["a@b.com.", "a@b.com.123", "a@b.com1", "a@b.co-x", "a@b", "a@b.example.com, c", "a@.com"]
    kept = [[t[x["start"] : x["end"]] for x in r["pii"]] for t, r in zip(texts, found(spark, *texts))]
    assert kept == [["a@b.com"], ["a@b.com"], [], [], [], ["a@b.example.com"], []]
