import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import scan_repair

CORPUS = "doc_id long, page_no int, text string"
WORDS = "harbour letter council another document reservoir monthly annual between returned inspector journal cabinet machine valve pressure engine summary column station".split()
PAIRS = "well-known long-term".split()


def page(rng, number, header="NORTHERN SURVEY OFFICE", faults=True):
    """(text, marks, sentences) of one made page whose faults are known."""
    body, marks = [], set()
    words = [rng.choice(WORDS + PAIRS) for _ in range(70)]
    lines, line = [], ""
    for w in words:
        if len(line) + len(w) > 44:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    lines.append(line + ".")
    lines[0] = lines[0].capitalize()
    out = [header, ""] + lines + [f"- {number} -"]
    marks |= {(1, "furniture"), (len(out), "furniture")}
    if faults:
        i = rng.randrange(3, len(out) - 3)
        for seen, true in (("c", "e"), ("0", "o"), ("rn", "m")):
            first = out[i].split()[0]
            if true in first and first.isalpha():
                out[i] = out[i].replace(true, seen, 1)
                marks.add((i + 1, "misread"))
                break
        j = rng.randrange(3, len(out) - 2)
        word = out[j].split()[0]
        if j != i and j - 1 != i and word.isalpha() and len(word) > 5 and not out[j - 1].endswith("-"):
            out[j - 1] += " " + word[:3] + "-"
            out[j] = out[j].replace(word, word[3:], 1)
            marks.add((j, "hyphen"))
        body = out
    return "\n".join(body or out), marks, " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, truth, words = [], {}, {}
    for d in range(300):
        text, marks, said = page(rng, d + 1, faults=d % 6 == 0)
        rows.append((d, d + 1 if d % 5 else None, text))
        truth[d], words[d] = marks, said
    rows += [(900, 1, None), (901, 1, ""), (902, 2, " \n \n"), (None, 3, "lost")]
    df = spark.createDataFrame(rows + rows[:10], CORPUS).withColumn("marks", F.lit("clash")).withColumn("line_no", F.lit(1))
    return df, truth, words


def test_marks_and_text(corpus):
    df, truth, words = corpus
    got = {r.doc_id: r for r in scan_repair.scan_repair(df).collect()}
    assert set(got) == set(truth) | {901, 902} and got[901].text == "" and got[902].text == "" and got[902].marks == []
    found = {(d, m.line_no, m.kind) for d, r in got.items() for m in r.marks}
    want = {(d, *m) for d, marks in truth.items() for m in marks}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.03 * len(want)
    same = sum(got[d].text.lower().rstrip(".") == words[d] for d in truth)
    assert same >= 0.9 * len(truth)


def test_words_beyond_the_bound_are_found(corpus):
    """With hardly any word at hand all others are looked up in the full table: the same pages come out."""
    df, truth, words = corpus
    whole = {r.doc_id: r for r in scan_repair.scan_repair(df).collect()}
    few = {r.doc_id: r for r in scan_repair.scan_repair(df, most_words=4, most_templates=2).collect()}
    assert set(few) == set(whole)
    same = sum(few[d].text == whole[d].text and few[d].marks == whole[d].marks for d in whole)
    assert same >= 0.97 * len(whole)


def test_parts():
    lang = scan_repair.Language({"former": 900, "known": 500, "well": 400, "well-known": 300, "received": 800, "modern": 500, "the": 990}, {"survey office": 40}, 1000)
    assert lang.read("formcr")[0] == "former" and lang.read("m0dcrn")[0] == "modern" and lang.read("zebra")[0] == "zebra"
    text, marks = scan_repair.repair("The formcr well-\nknown rece-\n[12]\nSURVEY OFFICE\nived modern.", 12, lang)
    assert marks == [(1, "misread"), (2, "hyphen"), (3, "furniture"), (4, "furniture")]
    assert text == "The former well-known received modern."
    assert scan_repair.page_number("- l2 -") == (12, True) and scan_repair.page_number("xiv") == (14, False) and scan_repair.page_number("a line") is None
    assert scan_repair.repair(None, None, lang) == ("", [])
    long = "The former known received. " * 4000
    assert scan_repair.repair(long, None, lang)[0] == long.strip()
    assert scan_repair.Kin({"harbour"}).__contains__("harbovr") and "harbou" in scan_repair.Kin({"harbour"}) and "garden" not in scan_repair.Kin({"harbour"})


def test_empty(spark):
    assert scan_repair.scan_repair(spark.createDataFrame([], CORPUS)).count() == 0


@pytest.mark.parametrize("pages", [700, 7_200, 720_000])
def test_words_of_few_pages_are_read_in_any_collection(pages):
    lang = scan_repair.Language({"trudasta": 20, "bevikol": 4, "the": pages // 2, "modern": pages // 10, "tar": 5, "far-reaching": pages // 10}, {}, pages)
    assert lang.read("truclasta")[0] == "trudasta" and lang.read("bcvikol")[0] == "bevikol" and lang.read("modcrn")[0] == "modern"
    assert lang.read("far")[0] == "far"  # a part of hyphenated words is known
    assert scan_repair.repair("The truclasta the.", None, lang) == ("The trudasta the.", [(1, "misread")])


def test_nothing_is_bounded_by_size():
    words = {f"title{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}word": 9 for i in range(12_000)}
    lines = {f"{w} office" + " of a very long heading" * 4: 9 for w in words}  # above 80 letters
    lang = scan_repair.Language({}, lines, 20_000)
    assert len(lang.title_lines.words) == 12_000
    assert all(("".join(t.split()))[:-1] + "q" in lang.title_lines for t in list(lines)[-50:])
    rare = scan_repair.Kin({f"k{i:05d}word" for i in range(20_000)})
    assert "k19999wora" in rare and "k19999ward" in rare and "k1999word" in rare and "k1abcdword" not in rare
    long = "donaudampfschifffahrtsgesellschaften"
    lang = scan_repair.Language({long: 50, "the": 900}, {}, 1_000)
    assert lang.read("donaudarnpfschifffahrtsgesellschaftcn")[0] == long and lang.read("x" * 40)[0] == "x" * 40
    assert scan_repair.misread_cost("rnodcrn", "modern", 4) == 2 == scan_repair.Language({}, {}, 1).candidates("rnodcrn", 4)["modern"] and scan_repair.misread_cost("abc", "abd", 4) is None
    text = "\n".join(["a line of one long paragraph that goes on and on"] * 200)
    assert "\n\n" not in scan_repair.repair(text, None, lang)[0]


def test_beyond_the_bound_nothing_is_lost(spark):
    """Title words, long words, parts of hyphenated words and letter shapes that are not at hand count as those that are."""
    long, heads = "donaudampfschifffahrtsgesellschaften", ("summary", "journal", "cabinet")
    rows = []
    for d in range(180):
        lines = [f"Monthly harbour {heads[d % 3]}", "", f"The council returned {long if d < 20 else 'another'} document", "between tar and the harbour", "banana banan bana bananas nana ana" if d < 60 else "the inspector"]
        lines.append("with far-reaching and constitutional pressure." if d < 60 else "and a banona-post." if d < 63 else "and the engine.")
        rows.append((d, None, "\n".join(lines)))
    odd = ["Month1y harb0ur surnmary", "", "The council donaudarnpfschifffahrtsgesellschaftcn document", "between far and the banona", "of the c0nst1tut10na1 pressure."]
    rows.append((500, None, "\n".join(odd)))
    df = spark.createDataFrame(rows, CORPUS)
    whole, few, words, lines = (
        {r.doc_id: (r.text, sorted((m.line_no, m.kind) for m in r.marks)) for r in scan_repair.scan_repair(df, **most).collect()}
        for most in ({}, {"most_words": 2, "most_templates": 1}, {"most_words": 2}, {"most_templates": 1})
    )
    text = f"The council {long} document between far and the banana of the constitutional pressure."
    assert few == whole and words == whole and lines == whole
    assert whole[500] == (text, [(1, "furniture"), (3, "misread"), (4, "misread"), (5, "misread")])


def test_misreadings_are_found_by_form():
    for seen, ways in scan_repair.CONFUSIONS.items():
        assert all(scan_repair.form(true) == scan_repair.form(seen) for true, _ in ways)
    assert not {c for made in scan_repair.FORM.values() for c in made} & set(scan_repair.FORM)  # so letters may be replaced in any order
    rng = random.Random(3)
    known = {"".join(rng.choice("ceoalinrmdhu") for _ in range(rng.randrange(2, 6))): 5 for _ in range(20_000)}
    lang = scan_repair.Language(known, {}, 1_000)
    for w in rng.sample(sorted(known), 300):
        for seen in (w, w.replace("o", "0"), w.replace("m", "rn")):
            for most in (1, 2, 4):
                assert lang.alike(seen, most) == {c: cost for c, cost in lang.candidates(seen, most).items() if c in known and c != seen}


def test_title_words_beyond_the_bound(spark):
    """The keys that two strings have in common find all that ``Kin`` finds."""
    rng = random.Random(4)
    known = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) for _ in range(150)}
    asked = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    kin = scan_repair.Kin(known)
    every = scan_repair.keyed(spark.createDataFrame([("title", w, w, 9) for w in known], "kind string, w string, word string, count long"))
    rows = spark.createDataFrame([(i, " ".join(sorted(asked)[i::3]), None) for i in range(3)], "doc_id long, text string, page_no int")

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            for d, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                got = set(text.split()) - {x["w"] for x in found or ()}
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(got), pa.int64()), pa.array(["title"] * len(got)), pa.array(sorted(got), pa.string())], ["doc_id", "kind", "w"])

    got = {x.w for r in scan_repair.settled(rows, ask, every).collect() for x in r.found or ()}
    assert got == {w for w in asked if w in kin}


def test_paragraphs_are_the_cheapest_chain():
    rng = random.Random(5)
    for n in (1, 2, 13, 14, 40):
        lines = [rng.choice(["A word", "  word on", "word and more of it.", "end."]) if rng.random() < 0.9 else "" for _ in range(n)]
        words = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
        got = scan_repair.paragraphs(lines, [False] * n, words)
        assert " ".join(got) == " ".join(t for _, t in words)
