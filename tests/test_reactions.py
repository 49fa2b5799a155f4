import random

import pytest

from lodestone.operators import lineage, reactions

COLUMNS = "gene string, paper int, ord int, reaction string, xref string, ecs array<string>, specific int, matches int, presence int"


def group(gene, ecs, xrefs, paper=1, **kw):
    """Candidates that tie in everything, in order."""
    v = {"specific": 2, "matches": 1, "presence": 1} | kw
    return [(gene, paper, i, f"r{i}", x, ecs, v["specific"], v["matches"], v["presence"]) for i, x in enumerate(xrefs)]


RULES = [
    (group("GPD1", ["1.1.1.8"], ["GLYCLTDX", "G3PD2", "GAPD"]), ["G3PD2"], "SPECIAL_G3P_RULE"),
    (group("tdh2", ["1.2.1.12", "1.1.1.8"], ["GLYCLTDX", "g3pd2", "GAPD"]), ["g3pd2", "GAPD"], "SPECIAL_G3P_RULE"),
    (group("tdh2", ["1.1.1.8"], ["GLYCLTDX", "G3PD2"]), ["GLYCLTDX", "G3PD2"], reactions.CASES["C"]),
    (group("glk", ["2.7.1.1"], ["ATPM", "HEX4", "HEX1", "X"]), ["HEX4", "HEX1"], "SPECIAL_ATPM_HEX2_RULE"),
    (group("glk", ["2.7.1.2"], ["HEX1", "ATPM"]), ["HEX1"], "SPECIAL_ATPM_HEX_RULE"),
    (group("glk", ["2.7.1.2", "9.9.9.9"], ["HEX1", "ATPM"]), ["HEX1", "ATPM"], reactions.CASES["C"]),
    (group("ldhB", ["1.1.1.27"], ["MDH", "LDH_D"]), ["LDH_D"], "SPECIAL_LDH_vs_MDH_RULE"),
    (group("lctE", ["1.4.1.9", "1.1.1.27"], ["MDH", "LDH_D"]), ["LDH_D"], "SPECIAL_LDH_vs_MDH_RULE"),
    (group("mdh", ["1.1.1.27"], ["MDH", "LDH_D"]), ["MDH", "LDH_D"], reactions.CASES["C"]),
    (group("yqeF", ["2.3.1.9"], ["ACACT2r", "ACACT1r"]), ["ACACT1r"], "SPECIAL_ACACT1r_RULE"),
    (group("fadA", ["2.3.1.16"], ["ACACT2r", "ACACT1r", "3OXCOAT"]), ["3OXCOAT"], "SPECIAL_3OXCOAT_RULE"),
    (group("fadA", ["2.3.1.16"], ["ACACT2r", "ACACT1r"]), ["ACACT2r", "ACACT1r"], reactions.CASES["C"]),  # nothing to take
    (group("ATF1p", ["3.1.2.20", "2.3.1.84", "1.1.1.1"], ["FACOAE60", "FACOAE80", "FACOAE181"]), ["FACOAE80", "OHACT1"], "SPECIAL_FACOAE80_RULE_WITH_OHACT1"),
    (group("pykF", ["2.7.1.40"], ["PPS", "PYK"]), ["PYK"], "SPECIAL_PYK_RULE"),
    (group("ptsG", ["6.1.1.18", "2.7.1.69"], ["GLNTRS", "TREPTSpp"]), ["TREPTSpp"], "SPECIAL_G3P_RULE"),
    (group("ptsH", ["6.1.1.18", "2.7.1.69"], ["GLNTRS", "TREPTSpp"]), ["GLNTRS", "TREPTSpp"], reactions.CASES["C"]),
]
#: (specific, matches, presence) of candidates, those that stay, the case
STAGES = [
    ([(2, 1, 1), (1, 9, 2)], [0], "single"),
    ([(2, 1, 0), (2, 1, 2), (1, 1, 2)], [1], "A"),
    ([(2, 1, 0), (2, 9, 0)], [1], "B"),
    ([(2, 3, None), (2, 9, 0)], [0], "A"),
    ([(2, 3, 1), (2, 3, 1), (2, 2, 1)], [0, 1], "C"),
    ([(0, 1, 2), (0, 2, 0)], [1], "D"),
    ([(0, 2, 1), (0, 2, 1), (0, 2, 0)], [0, 1], "E"),
    ([(0, 2, 1), (0, 2, 0), (0, 1, 2)], [0], "F"),
    ([(None, None, None), (0, 0, 0)], [0, 1], "E"),
]


def test_rules_and_stages(spark):
    rows, want = [], {}
    for p, (members, xrefs, case) in enumerate(RULES):
        rows += [(*r[:1], p, *r[2:]) for r in members]
        want[p] = (xrefs, case)
    for p, (members, left, case) in enumerate(STAGES, 100):
        rows += [("g", p, i, f"r{i}", f"x{i}", ["1.1.1.1"], *m) for i, m in enumerate(members)]
        want[p] = ([f"x{i}" for i in left], reactions.CASES[case])
    rows.append((None, 200, 0, "r", None, None, 1, 1, 1))
    want[200] = ([None], reactions.CASES["single"])
    for seed in (1, 2):  # the order of rows plays no part
        random.Random(seed).shuffle(rows)
        got = reactions.choose(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
        assert {r.paper: (r.xrefs, r.case) for r in got} == want
    one = {r.paper: r for r in got}
    assert one[0].alternatives == ["GLYCLTDX", "GAPD"] and one[0].reactions == ["r1"] and one[0].chosen_ecs == {"G3PD2": ["1.1.1.8"]}
    assert one[12].chosen_ecs == {"FACOAE80": ["1.1.1.1", "2.3.1.84", "3.1.2.20"], "OHACT1": []}
    assert one[101].specific == 2 and one[101].presence == 2
    assert reactions.choose(spark.createDataFrame([], COLUMNS)).count() == 0


def test_values_are_the_first_known_of_what_late_rules_leave(spark):
    rows = [("yqeF", 1, i, r, x, ["2.3.1.9"], 0, m, p) for i, (r, x, m, p) in enumerate([("r0", "ACACT2r", 7, 0), ("r1", "ACACT1r", 7, None), ("r1", "ACACT1r", 7, 0), ("r2", "ACACT1r", 7, 0)])]
    df = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(rows)], COLUMNS + ", share double")
    (one,) = reactions.choose(df, carry=("share",)).collect()
    assert (one.xrefs, one.reactions, one.matches, one.presence, one.share, one.case) == (["ACACT1r"], ["r1", "r2"], 7, 0, 1.0, "SPECIAL_ACACT1r_RULE")


def test_lineage(spark):
    rows = [(i, i - 1 if i % 50 else None, f"n{i}", "even" if i % 2 == 0 else "odd") for i in range(200)]
    rows += [(1000, 1000, "self", "even"), (1001, 5000, "orphan", "odd")]
    df = spark.createDataFrame(rows, "id long, parent long, name string, rank string")
    got = {r.id: r for r in lineage.lineage(df, ("even", "odd")).collect()}
    assert len(got) == 202 and got[149].path == "; ".join(f"n{i}" for i in range(100, 150)) and got[149].even == "n148" and got[149].odd == "n149"
    assert got[100].path == "n100" and got[100].odd is None and got[1000].path == "self" and got[1001].path == "orphan"
    up = lineage.ancestors(df).where("id = 149").collect()
    assert sorted((r.depth, r.ancestor) for r in up) == [(d, 149 - d) for d in range(1, 50)]
    for ring in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 4), (4, 2)], [(i, (i + 1) % 9) for i in range(9)]):
        with pytest.raises(ValueError, match="cycle"):
            lineage.ancestors(spark.createDataFrame(ring, "id long, parent long"))
    assert lineage.ancestors(df.limit(0)).count() == 0
