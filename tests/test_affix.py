from foliary.operators.affix import expand_dictionary
from foliary.sources.dictionary import read_affixes, read_stems

AFFIX = """SET UTF-8
FORBIDDENWORD q

SFX A Y 3
SFX A   0     s        [^sy]
SFX A   y     ies      [^aeiou]y
SFX A   0     er/PC    [^aeiou]

SFX C N 1
SFX C   0     ish      r

PFX N Y 1
PFX N   0     un       .

PFX P Y 1
PFX P   0     most     [^u]
"""
STEMS = """9
cat/AN
city/A
tie/A
fox
bad/Aq
sly/N
grand/C
"""


def test_expansion_of_files(spark, tmp_path):
    (tmp_path / "x.aff").write_text(AFFIX, encoding="utf-8")
    (tmp_path / "x.dic").write_text(STEMS, encoding="utf-8")
    rules = read_affixes(spark, str(tmp_path / "x.aff"))
    stems = read_stems(spark, str(tmp_path / "x.dic"))
    assert rules.count() == 6 and stems.count() == 7
    got = {}
    for row in expand_dictionary(stems, rules, "q").collect():
        got.setdefault(row.lemma, set()).add(row.surface)
    assert got == {
        "cat": {
            "cat", "cats", "cater", "caterish", "uncat", "uncats", "uncater", "mostcater",
        },
        "city": {"city", "cities", "cityer", "mostcityer", "cityerish"},
        "tie": {"tie", "ties"},
        "fox": {"fox"},
        "sly": {"sly", "unsly"},
        "grand": {"grand"},
    }
