import hashlib
import math
import re
from collections import defaultdict

import data
import pytest
from lodestone.llm import personal

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*PLAIN, "term"]
WORDS = re.compile(r"[^\W_]+")


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def fits(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end(), m.group(), prev, nxt) for k in PLAIN for m, prev, nxt in around(k, text) if fits(k, m.group())]


def around(kind, text):
    found = list(PLAIN[kind].finditer(text))
    for i, m in enumerate(found):
        yield m, text[found[i - 1].end() if i else 0 : m.start()], text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]


def terms(text):
    return {w for w in WORDS.findall(text.lower()) if len(w) > 1}


def context(before, behind, reach):
    if len(before) > reach:
        before = re.sub(r"^[^\W_]+", "", before[-reach:])
    if len(behind) > reach:
        behind = re.sub(r"[^\W_]+$", "", behind[:reach])
    return terms(before) | terms(behind)


def report(docs, threshold=0.9, support=3, reach=100):
    docs = [(d, t or "") for d, t in docs]
    found, near, holds, counts = [base(t) for _, t in docs], defaultdict(set), defaultdict(set), defaultdict(int)
    for r, (_, t) in enumerate(docs):
        for w in terms(t):
            counts[w] += 1
        for k, _, _, v, before, behind in found[r]:
            c = (k, re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower())
            holds[c].add(r)
            for w in context(before, behind, reach):
                near[c, w].add(r)
    risky = defaultdict(set)
    for (c, w), rows in near.items():
        n_c = len(holds[c])
        if len(rows) >= support and n_c >= support and n_c < len(docs):
            pmi = math.log2(len(docs) * len(rows) / (n_c * max(counts[w], len(rows))))
            if pmi / math.log2(len(docs) / n_c) >= threshold:
                for r in rows:
                    risky[r].add(w)
    out = []
    for r, (d, t) in enumerate(docs):
        own = [(s, KINDS.index(k), e) for k, s, e, *_ in found[r]]
        more = [(m.start(), 4, m.end()) for m in WORDS.finditer(t) if m.group().lower() in risky[r] and all(e <= m.start() or s >= m.end() for s, _, e in own)]
        say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        out.append((d, *[sum(k == i for _, k, _ in own) for i in range(4)], hashlib.sha256(say(own).encode()).hexdigest(), say(own + more)))
    return sorted(out, key=repr)


HARD = [
    "a@b.c_x@d.e.f", "x@y@z.w, .@a.b", "a@b", "%+@q-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 0000255.0.0.001", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111",
    "00000000000000", "+49 (30) 123.45-678 and +1-2", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++49301234567", "émile@exämple.org ünder é+4930123456789é", "𝔘𝔫 a@b.co 𝔠 10.0.0.1", " a@b.c ",
    "1" * 5000, "a" * 5000 + "@", "a." * 3000 + "@b" + ".c" * 4000, "+" * 3000, "1 " * 4000, None, "", "   ", "4111111111111111 4111111111111111", "mail: +4930123456789.5.6.7",
]


def told(n=60):
    """An address with a name that stands near it alone, one with common words, and one beside the other."""
    rows = []
    for i in range(n):
        text = f"the report of the day {i} is here"
        if i % 10 == 3:
            text = f"Call Brunhilde Zwirn of the team at Brun.Zwirn@firm.example or +49 30 1234 5678{'.' * (i % 3)} Zwirn again " + "the day is long " * 12 + "and zwirn"
        elif i % 10 == 4:
            text = "the day at info@open.example is here, the 10.1.2.3"
        rows.append((i, text))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=repr)


@pytest.mark.parametrize("rows", [list(enumerate(HARD)), told(), [(7, t) for t in HARD] + [(None, "a@b.c")], []])
def test_against_plain(spark, rows):
    assert got(personal.personal_report(data.documents(spark, rows) if all(d is not None for d, _ in rows) else spark.createDataFrame(rows, "doc_id long, text string"))) == report(rows)


def test_terms_of_a_protected_entity(spark):
    df = spark.createDataFrame(told(), "doc_id long, text string")
    spans = {r[0]: r[1] for r in personal.personal_report(df).select("doc_id", "spans").collect()}
    assert spans[3].count("term") >= 3 and "term" not in spans[0] + spans[4]
    text = {r[0]: r[1] for r in personal.sanitise(df).collect()}
    assert text[0] == told()[0][1]
    assert text[3].startswith("[NAME] [NAME] [NAME] of the ")
    assert "Zwirn" not in text[3] and "zwirn" not in text[3] and "[EMAIL]" in text[3] and "[PHONE]" in text[3]
    assert text[4].startswith("the day at [EMAIL] is here, the [IP]")


def test_driver_tables(spark):
    df = spark.read.parquet(f"{data.SF}/documents.parquet")
    assert got(personal.personal_report(df)) == report([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_native(spark):
    plan = personal.personal_report(data.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
