import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from lodestone.functions import terms

PARTS = [
    " . (", " . ", ". ,", "   ", "• ", " ; ", "a9. b", "xyZ. q", ". the ", " under ", " which ", " quickly ", " by ", " via ", " in Ab ", " resulted ", " in addition, ", " it was also found that ",
    " and hence ", "have been reported ", "has been used ", "hase been shown ", "was used", ". A", ". a", "). 9", ": ", ".", "x", "Éa", " ", "\n", "\x01", " ly ", "word ", "(b)", "。", "𝔸. b", "",
]


def texts(n=400):
    rnd = random.Random(5)
    return [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))) for i in range(n)] + [(n, None)]


def test_one_pattern_cuts_as_the_lists_do(spark):
    """Also where a text holds the character that tells cuts."""
    df = spark.createDataFrame(texts(), "id int, t string")
    for once, many in (("_ENDS_ONCE", "SENTENCE_ENDS"), ("_STRAY_ONCE", "STRAY_ENDS"), ("_MARKS_ONCE", "CLAUSE_MARKS"), ("_WORDS_ONCE", "CLAUSE_WORDS")):
        plain = F.split("t", f"(?U){'|'.join(getattr(terms, many))}")
        got = df.select("t", terms._split(F.col("t"), f"(?U){getattr(terms, once)}").alias("a"), plain.alias("b"))
        assert got.where("not (a <=> b)").collect() == [] and got.where("size(b) > 1").count() > 20


def test_no_pattern_is_made_once_a_text():
    """F.split() with more than one character makes its pattern for each sentence."""
    own = Path(terms.__file__).read_text().split("def sentences_of")[1]
    assert not re.search(r"F\.split\(", own)
