import random
import re

from pyspark.sql import functions as F

from lodestone.functions import splitters

ACIDS = {
    "lactic acid succinic acid": ["lactic acid", "succinic acid"],
    "poly lactic acid butyl succinic acid N-acyl glutamic acid": ["poly lactic acid", "butyl succinic acid", "N-acyl glutamic acid"],
    "ascorbic acid theanine": ["ascorbic acid", "theanine"],
    "amino acid (ala) l-theanine x": ["amino acid (ala)", "l-theanine x"],
    "fatty acid ethyl esters": ["fatty acid ethyl esters"],
    "fatty acid (faee)": ["fatty acid (faee)"],
    "acetic acid butanol": ["acetic acid", "butanol"],
    "sialic acid (sialate)": ["sialic acid (sialate)"],
    "lactate pyruvate": ["lactate", "pyruvate"],
    "lactate dehydrogenase citrate": ["lactate dehydrogenase", "citrate"],
    "isoamyl acetate phosphate": ["isoamyl acetate", "phosphate"],
    "glycerate phosphate": ["glycerate phosphate"],
    "lactate-co-glycolate": ["lactate-co-glycolate"],
    "lactate(x) citrate": ["lactate(x) citrate"],
    "ethanol": ["ethanol"],
    "": [""],
}
ANTIBIOTICS = {
    "antibiotic resistance gene": [],
    "polyketide antibiotic erythromycin": ["erythromycin"],
    "new antibiotics (old) nisin and anti-parasitic avermectin dose": ["new", "nisin", "and", "avermectin", "dose"],
    "Peptide antibiotics": ["antibiotic"],
    "antibiotic": ["antibiotic"],
    "red antibiotic": ["red antibiotic"],
    "antibiotic nisin peptide": ["nisin"],
    "butanol": ["butanol"],
}


def plain_acid(x):
    """The rules over one element by positions of matches."""
    I = re.I  # noqa: E741
    acids = list(re.finditer(r"\b\w+?ic\b\s+acid", x, I))
    part = lambda *at: [p.strip() for a, b in zip((0, *at), (*at, len(x))) if (p := x[a:b]).strip()]
    if len(acids) > 1:
        at = []
        for m in acids[1:]:
            yl = re.search(r"(?:\bN-?acyl\b|\b\w+yl\b)\s*$", x[: m.start()].rstrip(), I)
            at.append(yl.start() if yl else m.start())
        return part(*at)
    for p in (r"\bacid\s+(\w+(?:ine|one))\b", r"\bacid(?:\s+\([^)]+\))?\s+(\S+(?:ine|one))\b"):
        if m := re.search(p, x, I):
            return part(m.start(1))
    if re.search(splitters.FATTY, x, I):
        return [x]
    if m := re.search(r"\bacid(?!\s+\([\w\-]+\))\s+(?=\(?[\w\-]+)", x, I):
        return part(m.start() + 4)
    ates = list(re.finditer(r"\b\w+ate\b", x, I))
    if len(ates) < 2:
        return [x]
    a, b = ates[:2]
    if x[a.end()] in "-(":
        return [x]
    between, before = x[a.end() : b.start()].split(), x[: a.start()].split()
    if between and re.search(r"\w+ase$", between[-1], I):
        return part(x.index(between[-1]) + len(between[-1]))
    if not (before and before[-1].endswith("yl")) and b.group().lower() in splitters.TAILS:
        return [x]
    return part(a.end())


def plain_antibiotic(x):
    if re.search(r"\bantibiotic\s+resistance\b", x, re.I):
        return []
    found = list(re.finditer(splitters.NAMED, x, re.I))
    if not found:
        kinds = "|".join(map(re.escape, splitters.IGNORED))
        return ["antibiotic"] if re.match(rf"^(?:{kinds})?\s*antibiotics?\s*$", x.strip(), re.I) else [x]
    out, at = [], 0
    for m in found:
        out += [x[at : m.start()].strip(), m[2]]
        at = m.end()
    out.append(x[at:].strip())
    names = {m[2] for m in found}
    return [p for p in out if p and (p in names or p.lower() not in splitters.IGNORED)]


def hold(spark, function, cases, plain, words):
    rnd = random.Random(4)
    items = [*cases, *(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(500))]
    assert [plain(x) for x in cases] == list(cases.values())
    lists = [items[i : i + 3] for i in range(0, len(items), 3)] + [[], [None], [None, "ethanol"], None]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, l array<string>")
    got = {r.id: r.v for r in df.select("id", function(F.col("l")).alias("v")).collect()}
    for i, each in enumerate(lists):
        want = None if each is None else [y for x in each for y in ([x] if x is None else plain(x))] or None
        assert got[i] == want, each


def test_acids(spark):
    hold(spark, splitters.split_acids, ACIDS, plain_acid, ["lactic", "acid", "Acid", "butyl", "N-acyl", "theanine", "(x)", "lactone", "fatty", "ester", "citrate", "phosphate", "lactate", "reductase", "lactate-x", "ol", "épicéic", "x"])
    df = spark.createDataFrame([(["lactate-co-glycolate", "x"],)], "l array<string>")
    assert df.select(splitters.split_acids(F.col("l"), keep_all=False)).first()[0] == ["x"]


def test_antibiotics(spark):
    hold(spark, splitters.split_antibiotics, ANTIBIOTICS, plain_antibiotic, ["antibiotic", "Antibiotics", "nisin", "(old)", "peptide", "macrolide", "anti-parasitic", "antiparasitic", "avermectin", "and", "resistance", "cyclic", "lipopeptide"])
