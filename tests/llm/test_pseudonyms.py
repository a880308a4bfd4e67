import hashlib
import re

import pytest

from churnlens.llm import pseudonyms as P

SF = "/root/testdata/sf0.01"
KEY = "k1"


def noise(kind, i, other):
    return int(hashlib.sha256(f"{KEY}|{kind}|{i}|{other}".encode()).hexdigest()[:15], 16)


def pair(kind, x, y, a, b):
    for i in range(P.ROUNDS):
        if i % 2 == 0:
            x = (x + noise(kind, i, y)) % a
        else:
            y = (y + noise(kind, i, x)) % b
    return x, y


def digits(kind, d):
    a, b = len(d) // 2, len(d) - len(d) // 2
    x, y = pair(kind, int(d[:a] or 0), int(d[a:] or 0), 10**a, 10**b)
    return (str(x).zfill(a) if a else "") + str(y).zfill(b)


def letters(s):
    c = list(s)
    for i in range(P.ROUNDS):
        other = "".join(x for j, x in enumerate(c) if j % 2 != i % 2).lower()
        for j in range(i % 2, len(c), 2):
            for lo, n in (("a", 26), ("A", 26), ("0", 10)):
                if lo <= c[j] <= chr(ord(lo) + n - 1):
                    c[j] = chr(ord(lo) + (ord(c[j]) - ord(lo) + noise("email", i, f"{j}|{other}")) % n)
                    break
    return "".join(c)


def luhn(d):
    return sum((2 * int(c) // 10 + 2 * int(c) % 10) if i % 2 else int(c) for i, c in enumerate(reversed(d)))


def slow(text):
    """E-mail addresses, telephone numbers, cards and IPv4 addresses as the test tables hold them."""
    def one(m):
        v = m[0]
        if "@" in v:
            name, host = v.split("@")
            return f"{letters(name)}@{host}"
        if v[0] == "+":
            d = re.sub(r"\D", "", v)
            p = iter(d[:-10] + digits("phone", d[-10:]))
            return re.sub(r"\d", lambda _: next(p), v)
        if "." in v:
            q = [int(x) for x in v.split(".")]
            if max(q) > 255:
                return v
            x, y = pair("ip", q[0] * 256 + q[1], q[2] * 256 + q[3], 65536, 65536)
            return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
        if luhn(v) % 10 or not int(v):
            return v
        p = digits("card", v[:-1])
        return p + str(-luhn(p + "0") % 10)

    return re.sub(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}|\+\d{1,3} \(\d{3}\) \d{3}-\d{4}(?![0-9A-Za-z])"
                  r"|(?<![0-9A-Za-z.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9A-Za-z]|\.\d)|(?<![0-9A-Za-z])\d{13,19}(?![0-9A-Za-z])", one, text)


def test_matches_brute_force_and_turns_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = P.pseudonymise(docs, KEY)
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == {i: slow(t) for i, t in texts.items()}
    assert sum(r.n_email + r.n_phone + r.n_card + r.n_ip for r in rows) > 40
    assert {r.doc_id: r.text for r in P.pseudonymise(out, KEY, back=True).collect()} == texts


CASES = [
    ("card 4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111; amex 378282246310005; bad 4111111111111112, 0000000000000000", ["n_card", 4]),
    ("2024-02-29 02/29/2024 29.02.2024 not 2023-02-29 13/13/2020 1799-12-31 but 1800-01-01 and 2199-12-31", ["n_date", 5]),
    ("123-45-6789 899-99-9999 665-01-0001 667-01-0001 not 666-12-1234 900-12-1234 000-12-1234 123-00-1234 123-45-0000", ["n_ssn", 4]),
    ("DE89370400440532013000 and DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 not GB83WEST12345698765432", ["n_iban", 3]),
    ("0.0.0.0 255.255.255.255 1.2.3.4, not 256.1.1.1 1.2.3.4.5 01.2.3.4", ["n_ip", 3]),
    ("(988) 555-2485 988-555-2485 +1 988.555.2485 +49 (988) 555-2485", ["n_phone", 4]),
    ("a@b.co A.B-9@x-y.example.org, @none x@ é@y.org z@y", ["n_email", 2]),
]


@pytest.fixture(scope="module")
def cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    out = P.pseudonymise(df, KEY).cache()
    return df, out, {r.doc_id: r for r in out.collect()}


def test_counts_and_way_back(cases):
    df, out, rows = cases
    for i, (text, (name, n)) in enumerate(CASES):
        assert rows[i][name] == n, (text, rows[i])
        assert sum(rows[i][f"n_{k}"] for k in P.KINDS) == n
        assert rows[i]["text"] != text
        assert re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d+" if name == "n_ip" else r"\d", "9", rows[i]["text"]))) == \
            re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d+" if name == "n_ip" else r"\d", "9", text)))
    assert {r.doc_id: r.text for r in P.pseudonymise(out, KEY, back=True).collect()} == {i: t for i, (t, _) in enumerate(CASES)}
    assert {r.doc_id: r.text for r in P.pseudonymise(df, "other").collect()} != {i: rows[i]["text"] for i in rows}


def test_equal_values_stay_linked_and_valid(cases):
    _, _, rows = cases
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", rows[0]["text"])]
    assert cards[0] == cards[1] == cards[2] and luhn(cards[0]) % 10 == 0
    d = rows[1]["text"].split()
    assert d[1] == f"{d[0][5:7]}/{d[0][8:]}/{d[0][:4]}" and d[2] == f"{d[0][8:]}.{d[0][5:7]}.{d[0][:4]}"
    phones = [x[-10:] for x in (re.sub(r"\D", "", p) for p in re.findall(r"(?:\+\d+ )?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", rows[5]["text"]))]
    assert len(phones) == 4 and len(set(phones)) == 1


def test_small_domain_is_a_bijection(spark):
    """All SSNs of one area and group, and a run of days, stay distinct and valid."""
    texts = [f"666-01-{i:04d} 123-45-{i:04d}" for i in range(1, 400)]
    out = [r.text for r in P.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()]
    new = [t.split()[1] for t in out]
    assert all(t.split()[0] == s.split()[0] for t, s in zip(sorted(out), sorted(texts)))
    assert len(set(new)) == len(new) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new)


def test_edges(edge_docs, empty_docs):
    before = sorted((str(r.doc_id), str(r.text)) for r in edge_docs.select("doc_id", "text").collect())
    out = P.pseudonymise(edge_docs, KEY)
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == before  # nothing personal in these texts
    assert P.pseudonymise(empty_docs, KEY).count() == 0
    assert not re.search("Python|Pandas|Arrow|Exchange", out._jdf.queryExecution().executedPlan().toString())


def test_iban_before_a_word_and_values_inside_failed_candidates(spark):
    texts = [
        ("ES91 2100 0418 4502 0005 1332 BIC X", ["n_iban", 1]), ("AT611904300234573201 EUR", ["n_iban", 1]), ("SE45 5000 0000 0583 9825 7466 USD", ["n_iban", 1]),
        ("PL61 1090 1014 0000 0712 1981 2874 PLN BE68 5390 0754 7034 EUR NO93 8601 1117 947 NOK", ["n_iban", 3]), ("DE89 3704 0044 0532 0130 0 DE893704004405320130000", ["n_iban", 0]),
        ("NO12 4111 1111 1111 1111", ["n_card", 1]), ("DE12 4111 1111 1111 1111 12 end", ["n_card", 1]), ("1234 4111 1111 1111 1111", ["n_card", 1]),
        ("+1 (423) 555-7379 ZZ12 988-555-2485 378282246310005", ["n_phone", 2]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    out = P.pseudonymise(df, KEY).cache()
    for r in out.collect():
        text, (name, n) = texts[r.doc_id]
        assert r[name] == n, (text, r)
        assert re.sub(r"\d", "9", r.text) == re.sub(r"\d", "9", text) and (r.text != text) == (n > 0)
        assert [w for w in r.text.split() if w.isalpha()] == [w for w in text.split() if w.isalpha()]
    assert {r.doc_id: r.text for r in P.pseudonymise(out, KEY, back=True).collect()} == {i: t for i, (t, _) in enumerate(texts)}


def test_layouts_of_phones_dates_and_cards(spark):
    days = [f"{d}/{m:02d}/{y}" for y in (1800, 1900, 2000, 2024, 2199) for m in (1, 2, 12) for d in range(13, 29 if m == 2 else 32)]
    texts = [
        ("+49 30 1234567, +33 1 23 45 67 89 and +15551234567 or +44 (0)20 7946 0958 not 5551234567 +1234567", ["n_phone", 4]),
        ("+49 30 1234567 2024-02-29", ["n_phone", 1]), ("25/12/1990 31/01/2000 12/25/1990 05/06/2001 not 31/02/2000 13/13/2020", ["n_date", 4]),
        ("3782 822463 10005 3782-822463-10005 378282246310005 3056 930902 5904 not 3782 822463 10006", ["n_card", 4]), (" ".join(days), ["n_date", len(days)]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    out = P.pseudonymise(df, KEY).cache()
    rows = {r.doc_id: r for r in out.collect()}
    for i, (text, (name, n)) in enumerate(texts):
        assert rows[i][name] == n, (text, rows[i])
        assert re.sub(r"\d", "9", rows[i].text) == re.sub(r"\d", "9", text) and rows[i].text != text
    assert [re.match(r"\+\d+", x)[0][:k] for x, k in zip(re.findall(r"\+\S+", rows[0].text), (3, 3, 2, 3))] == ["+49", "+33", "+1", "+44"]
    assert rows[1].n_date == 1
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"\d{4}[ -]?\d{6}[ -]?\d{5}", rows[3].text)]
    assert cards[0] == cards[1] == cards[2] and luhn(cards[0]) % 10 == 0
    assert len(set(rows[4].text.split())) == len(days) and all(12 < int(x[:2]) for x in rows[4].text.split())
    assert {r.doc_id: r.text for r in P.pseudonymise(out, KEY, back=True).collect()} == {i: t for i, (t, _) in enumerate(texts)}


def test_long_texts_of_dense_candidates(spark):
    """A megabyte of what could begin a value but does not end one; tens of thousands of values in one text."""
    rows = [(i, "x@" + s * (1_000_000 // len(s)) + "com") for i, s in enumerate(["a.", "1.", "A1 ", "+1-"])]
    rows.append((9, "x@" + "a." * 127 + "com and y@" + "a." * 128 + "com"))
    many = " ".join(f"u{i}@example.com" for i in range(40_000))
    rows.append((10, many))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in P.pseudonymise(docs, "k").collect()}
    assert [out[i].n_email for i in (0, 1, 2, 9, 10)] == [0, 0, 0, 1, 40_000]
    assert out[2].text == rows[2][1]
    assert len(set(out[10].text.split())) == 40_000
    back = P.pseudonymise(spark.createDataFrame([(10, out[10].text)], "doc_id long, text string"), "k", back=True).first()
    assert back.text == many
