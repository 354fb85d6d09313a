"""Pseudonyms against a plain version of the networks and of the replacement."""

import datetime
import hashlib
import random
import re
import string
import struct

import regex
from xxhash import xxh64_intdigest

from tessella.llm import pii

KEY = "test key"
SCHEMA = "doc_id long, text string, n_chars int, hits string, pieces int, new string, row string, said int, same string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def rounds(key, *parts):
    return hashlib.sha256("/".join([key, *map(str, parts)]).encode()).hexdigest()


def amount(mask, i, n):
    return signed(xxh64_intdigest(struct.pack("<i", i), xxh64_intdigest(mask.encode(), 42))) % n


def shifted(s, mask):
    out = []
    for i, c in enumerate(s):
        first = next((x[0] for x in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in x), None)
        n = 10 if first == "0" else 26
        out.append(c if first is None else chr(ord(first) + (ord(c) - ord(first) + amount(mask, i, n)) % n))
    return "".join(out)


def feistel(s, key):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for r in range(1, 9):
        a, b = b, shifted(a, rounds(key, r, len(s), b))
    return a + b


def feistel_number(n, left, right, key):
    a, b = divmod(n, right)
    for r in range(1, 5):
        a = (a + signed(xxh64_intdigest(rounds(key, r, b).encode(), 42)) % left) % left
        b = (b + signed(xxh64_intdigest(rounds(key, -r, a).encode(), 42)) % right) % right
    return a * right + b


def refilled(shape, chars):
    it = iter(chars)
    return "".join(next(it) if re.match(r"[A-Za-z0-9]", c) else c for c in shape)


def luhn(digits, double_last):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if (i % 2 == 0) == double_last else 1)
        total += d - 9 if d > 9 else d
    return total


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def card(m):
    def passes(s):
        d = re.sub(r"\D", "", s)
        return 13 <= len(d) <= 19 and luhn(d, False) % 10 == 0

    def made(run):
        d = re.sub(r"\D", "", run)
        body = feistel(d[:-1], f"{KEY}/card")
        return refilled(run, body + str((10 - luhn(body, True) % 10) % 10))

    if passes(m):
        return made(m)
    groups = [x.span() for x in re.finditer(r"[^ -]+", m)]
    runs = [(a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:] if passes(m[a:b])]
    if not runs:
        return None
    a, b = min(runs, key=lambda r: (-len(re.sub(r"\D", "", m[r[0] : r[1]])), r[0]))
    return m[:a] + made(m[a:b]) + m[b:]


def iban(m):
    p = m.replace(" ", "")
    if len(p) < 15 or mod97(p) != 1:
        return None
    body = feistel(p[4:], f"{KEY}/iban")
    return refilled(m, f"{p[:2]}{98 - mod97(p[:2] + '00' + body):02d}{body}")


def date(m):
    iso = bool(re.match(r"\d{4}-", m))
    try:
        y, mo, d = map(int, (m[:4], m[5:7], m[8:]) if iso else (m[6:], m[3:5], m[:2]))
        at = datetime.date(y, mo, d).toordinal() - 1
    except ValueError:
        return None
    if at >= 24 * 146097:
        return None
    new = datetime.date.fromordinal(1 + at - at % 146097 + feistel_number(at % 146097, 189, 773, f"{KEY}/date"))
    y, mo, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return f"{y}-{mo}-{d}" if iso else f"{d}{m[2]}{mo}{m[2]}{y}"


def ip(m):
    octets = list(map(int, m.split(".")))
    if max(octets) > 255:
        return None
    n = feistel_number(int.from_bytes(bytes(octets), "big"), 65536, 65536, f"{KEY}/ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


ONE, TWO = {"1", "7"}, set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(m):
    trunk = re.match(r"\+[0-9]{1,3}[ .-]?(\(0\))", m)
    digits = [i for i, c in enumerate(m) if c.isdigit() and not (trunk and i == trunk.start(1) + 1)]
    number = "".join(m[i] for i in digits)
    code = number[: 1 if number[0] in ONE else 2 if number[:2] in TWO else 3] if m[0] == "+" else ""
    new = code + feistel(number[len(code) :], f"{KEY}/phone/{code or 1}")
    out = list(m)
    for i, c in zip(digits, new):
        out[i] = c
    return "".join(out)


def ssn(m):
    areas = [a for a in range(1, 900) if a != 666]
    n = (areas.index(int(m[:3])) * 99 + int(m[4:6]) - 1) * 9999 + int(m[7:]) - 1
    rest, serial = divmod(feistel_number(n, 898, 99 * 9999, f"{KEY}/ssn"), 9999)
    return f"{areas[rest // 99]:03d}-{rest % 99 + 1:02d}-{serial + 1:04d}"


def email(m):
    top = re.search(r"\.[^.@]*$", m)[0]
    rest = m[: len(m) - len(top)]
    return refilled(rest, feistel(re.sub(r"[^A-Za-z0-9]", "", rest), f"{KEY}/email")) + top


MAKERS = {"email": email, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "international": phone, "card": card, "iban": iban}


def plain(text):
    def new(m):
        for kind, pattern in pii.KINDS.items():
            if regex.fullmatch(pattern, m[0]) and kind in MAKERS and (made := MAKERS[kind](m[0])) is not None:
                return made
        return m[0]

    return regex.sub(pii.ANY, new, text)


def test_replacement_matches_the_plain_version(spark):
    rng = random.Random(3)
    bits = ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "378282246310005", "4111 1111 1111 1112", "12/27", "123", "2024-02-29", "2023-02-29", "31/12/1999", "01.01.0001", "1066-10-14", "9700-01-01",
            "123-45-6789", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 33", "256.1.1.1", "10.0.0.1", "me.u@x1.org", "jané.x@y.co.uk", "(988) 555-2485", "+1 988 555 2485", "+44 20 7946 0958", "988.555.2485", "+44 (0)20 7946 0958", "+15551234567", "000-12-3456", "666-12-3456", "123-00-4567", "899-99-9999", "+354 555 1234",
            "words", "é", "v1.2.3", ",", ";", "a@b", "12", "7"]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choices(bits, k=rng.randint(0, 8))) for _ in range(150)] + bits + ["", "pay 4111 1111 1111 1111 12 units", "x" * 100_000 + " 10.0.0.1 " + "y z " * 20_000]
    rows = [(i, t, None if t is None else len(t), "h", 1, "n", "r", 2, "s") for i, t in enumerate([*texts, None])]
    df = spark.createDataFrame(rows + [rows[3], (None, texts[0], None, None, None, None, None, None, None)], SCHEMA)
    got = pii.pseudonymised(df, KEY).collect()
    assert len(got) == len(rows) + 2 and got[0].__fields__ == [f.split()[0] for f in SCHEMA.split(", ")]
    for r in got:
        if r.doc_id is not None:
            want = None if r.doc_id == len(texts) else plain(texts[r.doc_id])
            assert r.text == want, texts[r.doc_id][:200]
            assert (r.hits, r.said, r.same) == ("h", 2, "s") and r.n_chars == (None if want is None else len(want))
    changed = {t for t in bits if plain(t) != t}
    assert changed == set(bits) - {"000-12-3456", "666-12-3456", "123-00-4567", "4111 1111 1111 1112", "12/27", "123", "2023-02-29", "9700-01-01", "GB82 WEST 1234 5698 7654 33", "256.1.1.1", "words", "é", "v1.2.3", ",", ";", "a@b", "12", "7"}
    assert pii.pseudonymised(df.limit(0), KEY).count() == 0


def test_addresses_keep_their_shape(spark):
    texts = ["at 2001:db8::1 now", "fe80::", "2001:0db8:0000:0000:0000:ff00:0042:8329", "std::vector", "12:30:45"]
    rows = [r.text for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert rows[0] != texts[0] and re.fullmatch(r"at [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f] now", rows[0])
    assert re.fullmatch(r"(?:[0-9a-f]{4}:){7}[0-9a-f]{4}", rows[2]) and rows[2] != texts[2] and rows[3:] == texts[3:]


def test_the_key_is_a_setting(spark):
    before = spark.conf.get(pii.SETTING, None)
    try:
        spark.conf.unset(pii.SETTING)
        drawn = pii.session_key(spark)
        assert len(drawn) == 64 and pii.session_key(spark) == drawn
        spark.conf.set(pii.SETTING, "mine")
        assert pii.session_key(spark) == "mine"
    finally:
        spark.conf.unset(pii.SETTING) if before is None else spark.conf.set(pii.SETTING, before)


def test_a_phone_number_is_one_in_every_notation(spark):
    same = [
        ["+1 555-123-4567", "+15551234567", "(555) 123-4567", "555.123.4567", "+1 (555) 123-4567", "555-123-4567"],
        ["+44 20 7946 0958", "+44 (0)20 7946 0958", "+442079460958", "+44.20.7946.0958"],
    ]
    rows = [(i, t) for i, ts in enumerate(same) for t in ts]
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    for i, code in enumerate(["1", "44"]):
        texts = [r.text.replace("(0)", "") for r in got if r.doc_id == i]
        numbers = {re.sub(r"[^0-9]", "", t)[len(code) if t[0] == "+" else 0 :] for t in texts}
        assert len(texts) == len(same[i]) and len(numbers) == 1 and not numbers & {"5551234567", "2079460958"}
        assert all(t.startswith(f"+{code}") for t in texts if t[0] == "+")


def test_no_plan_holds_the_key(spark):
    docs = spark.createDataFrame([(1, "call 555-123-4567")], "doc_id long, text string")
    for df in (pii.report(docs, "a-very-secret-key"), pii.pseudonymised(docs, "a-very-secret-key")):
        assert df.collect() and "a-very-secret-key" not in df._jdf.queryExecution().toString()
