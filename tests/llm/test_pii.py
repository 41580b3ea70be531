import hashlib
import re
from datetime import date, timedelta

from loomvault.llm import pii


def feistel(kind, a, b, size_a, size_b, key=pii.KEY):
    for r in range(1, pii.ROUNDS + 1):
        f = lambda x: int(hashlib.sha256(f"{key}|{kind}|{r}|{x}".encode()).hexdigest()[:12], 16)  # noqa: B023, E731
        if r % 2:
            a = (a + f(b)) % size_a
        else:
            b = (b + f(a)) % size_b
    return a, b


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def card(d):
    u = (len(d) - 2) // 2
    v = len(d) - 2 - u
    a, b = feistel("card", int(d[1 : 1 + u]), int(d[1 + u : -1]), 10**u, 10**v)
    body = d[0] + str(a).zfill(u) + str(b).zfill(v)
    return next(body + c for c in "0123456789" if luhn(body + c))


def ip(s):
    o = [int(x) for x in s.split(".")]
    a, b = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def day(s):
    n = (date.fromisoformat(s) - date(1900, 1, 1)).days
    while True:
        a, b = feistel("date", n // 271, n % 271, 271, 271)
        n = a * 271 + b
        if n < pii.DAYS:
            return (date(1900, 1, 1) + timedelta(n)).isoformat()


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pseudonymise(df).collect()}


def test_permutations_match_brute_force(spark):
    cards = ["4111111111111111", "4337166598464399", "378282246310005", "6011000990139424"]
    ips, days = ["42.144.35.254", "0.0.0.0", "255.255.255.255"], ["1970-02-28", "1900-01-01", "2099-12-31", "2000-02-29"]
    out = run(spark, [" ".join(cards), " ".join(ips), " ".join(days)])
    assert out[0]["text"].split() == [card(c) for c in cards] and all(luhn(c) for c in out[0]["text"].split())
    assert out[1]["text"].split() == [ip(x) for x in ips]
    assert out[2]["text"].split() == [day(x) for x in days]
    assert (out[0]["n_card"], out[1]["n_ip"], out[2]["n_date"]) == (4, 3, 4)


def test_equal_values_stay_linked_and_formats_stay(spark):
    out = run(spark, ["call +1 (456) 555-2186.", "(456) 555-2186 or 456-555-2186", "card 4111-1111-1111-1111, 4111111111111111", "a.b@mail.com, A.B@mail.com.", "ssn 123-45-6789", "28/02/1970 and 1970-02-28"])
    a, b = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})\.", out[0]["text"]).groups(), re.match(r"\((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})$", out[1]["text"]).groups()
    assert a == b[:3] == b[3:] and int(a[0]) >= 200 <= int(a[1]) and a != ("456", "555", "2186")
    c = re.match(r"card (\d{4}-\d{4}-\d{4}-\d{4}), (\d{16})$", out[2]["text"]).groups()
    assert c[0].replace("-", "") == c[1]
    d = re.match(r"(\S+@\S+), (\S+@\S+)\.$", out[3]["text"]).groups()
    assert d[0] == d[1] and "mail.com" not in out[3]["text"]
    s = re.match(r"ssn (\d{3})-(\d{2})-(\d{4})$", out[4]["text"]).groups()
    assert s[0] not in ("000", "666") and int(s[0]) < 900 and int(s[1]) and int(s[2])
    x, y = out[5]["text"].split(" and ")
    assert "-".join(reversed(x.split("/"))) == y


def test_different_values_stay_different(spark):
    out = run(spark, [f"+1 (212) 555-{i:04d}" for i in range(300)] + [f"10.0.{i}.7" for i in range(256)])
    assert len({r["text"] for r in out.values()}) == 556


def test_what_is_not_valid_stays(spark, docs, rows, empty):
    texts = [None, "", "4111111111111112", "999.1.1.1 and 1.2.3.4.5", "1970-02-30 666-12-1234", "version 1.2.3, 12345 words, x@y", "no digits at all"]
    out = run(spark, texts)
    assert [out[i]["text"] for i in range(len(texts))] == texts
    assert all(out[i][f"n_{k}"] == 0 for i in out for k in pii.KINDS)
    assert pii.pseudonymise(docs).count() == len(rows) and pii.pseudonymise(empty).count() == 0
    assert "Python" not in pii.pseudonymise(docs)._jdf.queryExecution().executedPlan().toString()


def test_no_two_values_share_a_pseudonym(spark):
    """All days of sixty years in three spellings, and telephone numbers in and out of the sets that are given out."""
    days = [date(1960, 1, 1) + timedelta(i) for i in range(0, 21900, 4)]
    texts = [d.isoformat() for d in days] + [d.strftime("%d/%m/%Y") for d in days] + [d.strftime("%m/%d/%Y") for d in days if d.day > 12]
    texts += [f"({a:03d}) {e:03d}-{i:04d}" for a in (0, 17, 199, 200, 999) for e in (0, 199, 200, 555) for i in range(0, 10000, 97)]
    out = run(spark, texts)
    new = [out[i]["text"] for i in range(len(texts))]
    assert len(set(new)) == len(set(texts)) == len(texts)
    for old, made in zip(texts, new, strict=True):
        assert re.sub("[0-9]", "9", old) == re.sub("[0-9]", "9", made)
        if "/" in old:
            assert (int(old[3:5]) > 12) == (int(made[3:5]) > 12)
        if "(" in old:
            assert (int(old[1:4]) < 200) == (int(made[1:4]) < 200)


def test_long_repeats_of_what_patterns_repeat(spark):
    """Each pattern's repeated parts, at a length at which recursion by repeats would end the JVM."""
    n = 60_000
    texts = ["a@" + "b." * n + "1", "a@" + "bc." * 100 + "org", "x" * n + "@mail.com", "1." * n, "1234 " * n, "4111-" * n, "1970-01-01/" * n, "(212) " * n, "1" * n, "a@b" * n, "+1 " * n]
    out = run(spark, texts)
    assert out[0]["text"] == texts[0]
    assert re.fullmatch(r"user\.[0-9a-f]{16}@mail\.invalid", out[1]["text"]) and re.fullmatch(r"user\.[0-9a-f]{16}@mail\.invalid", out[2]["text"])
    assert out[3]["text"] == texts[3]


def test_spellings_of_one_address_and_numbers_without_a_valid_code(spark):
    out = run(spark, ["010.0.0.1", "10.0.0.1", "123-456-7890 123-456-7891", "256.1.1.1"])
    assert out[0]["text"] == "010.0.0.1" and out[0]["n_ip"] == 0 and out[3]["text"] == "256.1.1.1"
    assert out[1]["text"] == ip("10.0.0.1")
    a, b = out[2]["text"].split()
    assert a != b and a[0] in "01" and b[0] in "01" and out[2]["n_phone"] == 2
